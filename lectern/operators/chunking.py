"""Headings, blocks and greedy packing of paragraphs.

A document's blocks are cut at its headings; packing is a fold over its
paragraphs, in one pass, without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TARGET, LEAST, MOST = 500, 120, 750
HEADING = r"^[ \t\r\f\x0b]{0,3}#{1,6}[ \t\r\f\x0b]+(.+?)[ \t\r\f\x0b]*$"


#: Where a line that is a heading begins. Lines end in \\n only.
BEFORE_HEADING = r"(?md)(?=^[ \t\r\f\x0b]{0,3}#{1,6}[ \t\r\f\x0b]+.+?[ \t\r\f\x0b]*$)"


def blocks(text: Column) -> Column:
    """The blocks of a text as an array of (heading, body); blocks without text and headings without a body drop out.

    The text is cut before its heading lines, in one pass whatever its length.
    """
    parts = F.split(text, BEFORE_HEADING)
    line = lambda x: F.substring_index(x, "\n", 1)
    head = lambda x: F.regexp_extract(line(x), HEADING.replace("^", "(?d)^", 1), 1)
    rest = lambda x: F.when(F.length(head(x)) > 0, F.substr(x, F.length(line(x)) + 2)).otherwise(x)
    found = F.transform(parts, lambda x: F.struct(head(x).alias("heading"), F.regexp_replace(rest(x), r"^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$", "").alias("body")))
    return F.filter(found, lambda b: b["body"] != "")


def heading_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a block: the id, ``block_no``, ``heading`` (empty before the first) and ``body``. Null texts have none."""
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(blocks(F.col(text_col))).alias("block_no", "b")).select(id_col, "block_no", "b.heading", "b.body")


UNIT = "struct<heading:string,text:string,tokens:int,alone:boolean,last:boolean>"


def pack(units: Column, target: int = TARGET, least: int = LEAST) -> Column:
    """Greedy packing of an array of UNIT into chunks (heading, parts, tokens).

    A unit joins the buffer unless that would exceed the target and the buffer
    is large enough by itself; ``alone`` units are chunks of their own. At the
    end of a block a large buffer is a chunk, a small one goes to the chunk
    before, under whatever heading, or is dropped if there is none.
    """
    chunk = "struct<heading:string,parts:array<string>,tokens:int>"
    empty = F.array().cast(f"array<{chunk}>")
    none = F.array().cast("array<string>")
    state = F.struct(empty.alias("out"), none.alias("buf"), F.lit(0).alias("tok"))
    make = lambda h, parts, tok: F.struct(h.alias("heading"), parts.alias("parts"), tok.cast("int").alias("tokens"))
    st = lambda out, buf, tok: F.struct(out.alias("out"), buf.alias("buf"), tok.cast("int").alias("tok"))

    def tail(acc: Column, u: Column) -> Column:
        last = F.element_at(acc["out"], -1)
        merged = F.array_append(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), make(last["heading"], F.concat(last["parts"], acc["buf"]), last["tokens"] + acc["tok"]))
        out = F.when(acc["tok"] >= least, F.array_append(acc["out"], make(u["heading"], acc["buf"], acc["tok"]))).when((acc["tok"] > 0) & (F.size(acc["out"]) > 0), merged).otherwise(acc["out"])
        return st(out, none, F.lit(0))

    def step(acc: Column, u: Column) -> Column:
        flushed = F.array_append(acc["out"], make(u["heading"], acc["buf"], acc["tok"]))
        alone = st(F.array_append(F.when(acc["tok"] > 0, flushed).otherwise(acc["out"]), make(u["heading"], F.array(u["text"]), u["tokens"])), none, F.lit(0))
        full = (acc["tok"] + u["tokens"] > target) & (acc["tok"] >= least)
        joined = st(F.when(full, flushed).otherwise(acc["out"]), F.when(full, F.array(u["text"])).otherwise(F.array_append(acc["buf"], u["text"])), F.when(full, u["tokens"]).otherwise(acc["tok"] + u["tokens"]))
        now = F.when(u["alone"], alone).otherwise(joined)
        return F.element_at(F.transform(F.array(now), lambda s: F.when(u["last"], tail(s, u)).otherwise(s)), 1)

    return F.aggregate(units, state, step, lambda acc: acc["out"])


def pieces_of_long(paragraph: Column, lang: Column, most: int = MOST) -> Column:
    """Sentences of a paragraph joined greedily up to ``most`` tokens; a longer sentence stays whole."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["buf"] == "", s).otherwise(F.concat_ws(" ", acc["buf"], s))
        fits = (acc["buf"] == "") | (T.approx_tokens(joined, lang) <= most)
        return F.struct(F.when(fits, acc["out"]).otherwise(F.array_append(acc["out"], acc["buf"])).alias("out"), F.when(fits, joined).otherwise(s).alias("buf"))

    return F.aggregate(T.sentences(paragraph), state, step, lambda acc: F.when(acc["buf"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["buf"])))


def pack_documents(df: DataFrame, id_col: str, text_col: str, lang_col: str, target: int = TARGET, least: int = LEAST, most: int = MOST) -> DataFrame:
    """A row a chunk: the id, ``seq``, ``heading``, ``n_parts``, ``tokens`` and ``text``.

    Blocks come from heading_blocks; a paragraph above ``most`` is cut into
    sentences. A document may vanish: see pack.
    """
    lang = F.coalesce(F.col(lang_col), F.lit("und"))
    unit = lambda b, k, s, alone: F.struct(b["heading"].alias("heading"), s.alias("text"), T.approx_tokens(s, lang).alias("tokens"), alone.alias("alone"), k.alias("block"))

    def of_paragraph(b: Column, k: Column, p: Column) -> Column:
        alone = T.approx_tokens(p, lang) > most
        return F.transform(F.when(alone, pieces_of_long(p, lang, most)).otherwise(F.array(p)), lambda s: unit(b, k, s, alone))

    units = F.flatten(F.transform("blocks_", lambda b, k: F.flatten(F.transform(T.paragraphs(b["body"]), lambda p: of_paragraph(b, k, p)))))
    # all within the row: no shuffle, whatever the number of documents
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, lang_col, blocks(F.col(text_col)).alias("blocks_")).select(id_col, units.alias("u"))
    last = lambda u, i: F.coalesce(F.get(F.col("u"), i + 1)["block"] != u["block"], F.lit(True))
    flagged = F.transform("u", lambda u, i: F.struct(u["heading"].alias("heading"), u["text"].alias("text"), u["tokens"].alias("tokens"), u["alone"].alias("alone"), last(u, i).alias("last")))
    out = rows.select(id_col, F.posexplode(pack(flagged, target, least)).alias("seq", "c"))
    return out.select(id_col, "seq", "c.heading", F.size("c.parts").alias("n_parts"), "c.tokens", F.array_join("c.parts", "\n\n").alias("text"))
