"""Finding and repairing text decoded with a wrong encoding (problem 3).

Method: expectation-maximisation with latent encoding chains, pooled by source
and field. A chain is the encoding the bytes were read in and the one they were
written in (or two such steps). Stretches of text that some chain can undo are
the candidates; the latent variable is which chain, if any, a stretch went
through. The prior of each chain is estimated for every source and field and
drawn towards the corpus, so that weak evidence on one page is strengthened by
the other pages of its host. The emission is a unigram model of code points by
script group, taken from the whole corpus and corrected in every round by what
the posterior moves from the garbled to the restored form.

A replacement character is a loss that no chain undoes. It is evidence like any
other: the chain ``lost`` explains it, clean text has to pay for it, and where
the loss is the likelier cause the stretch is found, without a repair.

Defined results: null, empty and pure ASCII texts are never found. A null source
is a source of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .lookalikes import LOOKALIKE

LOST = chr(0xFFFD)
#: The encodings considered. Read as one of these, written as the other.
SINGLE = ("w1252", "mac_roman", "cp437", "cp850", "cp1251")
WIDE = ("gb18030", "big5", "cp932", "cp949", "euc_jp")
GROUPS = ("latin", "han", "kana", "hangul")
ROUNDS = 3
#: Nats a chain costs before any evidence; the first round's prior.
PRIOR = -4.6
PULL = 100.0
#: Nats for a stretch in another script group than the rest of its row.
AWAY = 12.0
NO_CHAIN = "none"
#: What was lost, as a cause beside the chains.
LOSS = "lost"
#: Clean stretches a row counts for, beside its candidates.
CLEAN = 20.0
#: Not an encoding: letters put in for ones that look alike (problem 7). It competes with the chains.
LOOKS = "look-alike"


def _single_bytes(codec: str) -> dict[str, int]:
    """Byte by character; for w1252 the C1 controls as well."""
    out = {}
    for b in range(256):
        if codec == "w1252":
            out[chr(b)] = b
        try:
            out[bytes([b]).decode("cp1252" if codec == "w1252" else codec)] = b
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(None)
def _table(codec: str) -> dict[int, int]:
    return {ord(c): b for c, b in _single_bytes(codec).items()}


def _class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


@lru_cache(None)
def _islands(codec: str) -> re.Pattern:
    """Stretches that are well-formed UTF-8 once written back as bytes of this codec."""
    by = _single_bytes(codec)
    pick = lambda lo, hi: _class([c for c, b in by.items() if lo <= b <= hi])
    tail = pick(0x80, 0xBF)
    return re.compile(f"(?:{pick(0xC2, 0xDF)}{tail}|{pick(0xE0, 0xEF)}{tail}{tail}|{pick(0xF0, 0xF4)}{tail}{tail}{tail})+")


@lru_cache(None)
def _any_island() -> re.Pattern:
    """A lead and a tail of any of the single-byte codecs, in this order: what every island begins with."""
    lead, tail = set(), set()
    for codec in SINGLE:
        for c, b in _single_bytes(codec).items():
            if 0xC2 <= b <= 0xF4:
                lead.add(c)
            elif 0x80 <= b <= 0xBF:
                tail.add(c)
    return re.compile(_class(sorted(lead)) + _class(sorted(tail)))


@lru_cache(None)
def _dense() -> re.Pattern:
    """Stretches thick with upper-half characters of cp1252: East Asian bytes read one by one."""
    high = _class([c for c, b in _single_bytes("w1252").items() if b >= 0x80])
    return re.compile(f"{high}[!-~]?{high}[!-~]?{high}(?:[!-~]?{high})*[@-~]?")


#: Controls and private use, which no restored text holds.
NO_TEXT = re.compile(r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f" + chr(0xE000) + "-" + chr(0xF8FF) + "]")
WIDE_RUN = re.compile("[^\x00-\x7f]+")
EAST = re.compile("[" + chr(0x2E80) + "-" + chr(0xD7AF) + chr(0xE000) + "-" + chr(0xFFFD) + "]")
EAST_RUN = "[" + chr(0x2E80) + "-" + chr(0xD7AF) + chr(0xF900) + "-" + chr(0xFFEF) + "]"
#: Nats below the plain reading that a prior does not make up for: a source would need some CLEAN x e^6 = 8000 garbled stretches a row.
HOPELESS = -6.0


def _to_bytes(text: str, codec: str) -> bytes | None:
    if codec in SINGLE:
        try:
            return bytes(map(_table(codec).__getitem__, map(ord, text)))
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def _from_bytes(raw: bytes, codec: str) -> str | None:
    try:
        out = raw.decode(codec)
    except UnicodeDecodeError:
        return None
    return None if NO_TEXT.search(out) else out


def _wide_candidates(run: str) -> list[tuple[str, str]]:
    out = []
    for read in WIDE[:4]:
        raw = _to_bytes(run, read)
        if raw is None or len(raw) == len(run):
            continue
        for written in ("utf-8", *WIDE):
            # two double-byte encodings fit each other by chance; four characters in a row seldom do
            if written != read and (written == "utf-8" or len(run) >= 4) and (text := _from_bytes(raw, written)) is not None and text != run:
                out.append((f"{read}<{written}", text))
    return out


_runs: dict[str, list[tuple[str, str]]] = {}


def candidates(text: str) -> list[tuple[int, int, list[tuple[str, str]]]]:
    """The stretches of a text that some chain can undo: start, end, and (chain, restored text) of each chain.

    A stretch with nothing but a loss has no chain to undo it.
    """
    if text.isascii():
        return []
    out: list[tuple[int, int, list[tuple[str, str]]]] = []
    if _any_island().search(text):
        for codec in SINGLE:
            for m in _islands(codec).finditer(text):
                fixed = _from_bytes(_to_bytes(m.group(), codec), "utf-8")
                if fixed is not None:
                    chains, again = [(f"{codec}<utf-8", fixed)], fixed
                    if not fixed.isascii():
                        # a second step of the same kind
                        again = _islands(codec).sub(lambda x: _from_bytes(_to_bytes(x.group(), codec), "utf-8") or x.group(), fixed)
                        if again != fixed:
                            chains.append((f"{codec}<utf-8 twice", again))
                    out.append((*m.span(), chains))
    for m in _dense().finditer(text):
        raw = _to_bytes(m.group(), "w1252")
        if raw is not None:
            found = [(f"w1252<{c}", fixed) for c in WIDE if (fixed := _from_bytes(raw, c)) is not None or (fixed := _from_bytes(raw[:-1], c)) is not None]
            if found:
                out.append((*m.span(), found))
    for m in WIDE_RUN.finditer(text):
        run = m.group()
        known = _runs.get(run)
        if known is None:
            known = _wide_candidates(run) if EAST.search(run) else []
            if LOST in run:
                known = [(LOSS, LOST)]
                for part in re.finditer(f"[^{LOST}]{{4,}}", run):
                    known += [(c, run[: part.start()] + t + run[part.end() :]) for c, t in _wide_candidates(part.group())]
            if len(run) <= 24:
                if len(_runs) > 200_000:
                    _runs.clear()
                _runs[run] = known
        if known:
            out.append((*m.span(), known))
    return out


def script_group(text: str) -> int:
    """The script group of a text: its place in GROUPS."""
    if text.isascii():
        return 0
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kana = int(((c >= 0x3040) & (c <= 0x30FF)).sum())
    hangul = int(((c >= 0xAC00) & (c <= 0xD7AF)).sum())
    han = int(((c >= 0x4E00) & (c <= 0x9FFF)).sum())
    if 8 * (kana + hangul + han) < len(c):
        return 0
    return 3 if hangul >= max(kana, han) else 2 if 6 * kana > han else 1


def char_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Code points by script group over all rows: ``group_``, ``cp`` and ``n``; at most 4 x 1 114 112 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(GROUPS), 0x110000), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    c = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
                    total[script_group(text), : len(c)] += c
        g, cp = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(cp, pa.int32()), pa.array(total[g, cp])], names=["group_", "cp", "n"])

    return df.select(text_col).mapInArrow(run, "group_ int, cp int, n bigint").groupBy("group_", "cp").agg(F.sum("n").alias("n"))


class CharModel:
    """Log probability of a string under the best of the script groups.

    A code point not seen counts as a little where its block of 128 is in use, and as next to nothing where it is not.
    """

    def __init__(self, counts: list[dict[str, float]]):
        self.totals = [sum(c.values()) + 100.0 for c in counts]
        self.logs = [{c: math.log(n / total) for c, n in by.items() if n > 0.02} for by, total in zip(counts, self.totals)]
        self.blocks = []
        for by in counts:
            blocks: Counter = Counter()
            for c, n in by.items():
                blocks[ord(c) >> 7] += max(n, 0)
            self.blocks.append({b for b, n in blocks.items() if n > 2})

    def score(self, text: str, home: int) -> float:
        best = -math.inf
        for g, (logs, total, blocks) in enumerate(zip(self.logs, self.totals, self.blocks)):
            s, rare = 0.0 if g == home else -AWAY, math.log(0.02 / total)
            for c in text:
                known = logs.get(c)
                s += known if known is not None else rare if ord(c) >> 7 in blocks else rare - 12.0
            best = max(best, s)
        return best


def _fits(before: str, text: str, after: str) -> float:
    """Nats a restored text loses where it ends in a letter foreign to the Latin letter beside it."""
    foreign = lambda c: c.isalpha() and ord(c) >= 0x250 or 0x300 <= ord(c) < 0x370
    latin = lambda c: c.isalpha() and ord(c) < 0x250
    return -8.0 * (bool(before) and latin(before) and foreign(text[0])) - 8.0 * (bool(after) and latin(after) and foreign(text[-1]))


ISLANDS = "id_ {kind}, field_ string, source_ string, group_ int, start_ int, end_ int, seen string, chains array<string>, texts array<string>, fits array<double>"


def _compete(text: str, found: list, group: int, score) -> list[tuple[int, int, list[tuple[str, str, float]]]]:
    """The stretches worth weighing; of those that overlap, the one with the likeliest restoration."""
    kept = []
    for a, b, chains in found:
        seen = text[a:b]
        # one East Asian character by itself among Latin words
        alone = 4.0 if group == 0 and b - a == 1 and EAST.match(seen) and not EAST.search(text[max(0, a - 2) : a] + text[b : b + 2]) else 0.0
        base = score(seen, group) + HOPELESS
        worth, top = [], -math.inf
        for c, t in chains:
            if c == LOSS:
                worth.append((c, t, 0.0))
                top = max(top, 0.0)
            elif t:
                fit = alone + _fits(text[a - 1 : a], t, text[b : b + 1])
                gain = score(t, group) + fit - base
                if gain > 0:
                    worth.append((c, t, fit))
                    top = max(top, gain)
        if worth:
            if all(c in LOOKALIKE or c.isascii() for c in seen):
                worth.append((LOOKS, "".join(LOOKALIKE.get(c, c) for c in seen), 0.0))
            kept.append((top, a, b, worth))
    out: list = []
    for _, a, b, worth in sorted(kept, key=lambda x: (-x[0], x[1])):
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, worth))
    return sorted(out)


def extract(df: DataFrame, id_col: str, text_col: str, source, field: str, model) -> DataFrame:
    """The candidate stretches of all rows; ASCII texts are filtered out before Python sees them."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id_", "field_", "source_", "group_", "start_", "end_", "seen", "chains", "texts", "fits"]
    rows = df.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), F.coalesce(source, F.lit("")).alias("source_")).where(F.octet_length("text_") > F.length("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        score = model.value.score
        for batch in batches:
            ids, sources = batch.column(0), batch.column(2)
            row, cols = [], [[] for _ in range(7)]
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = candidates(text)
                if found:
                    group = script_group(text)
                    for a, b, chains in _compete(text, found, group, score):
                        row.append(k)
                        for col, x in zip(cols, (group, a, b, text[a:b], *([x[i] for x in chains] for i in range(3)))):
                            col.append(x)
            take = pa.array(row, pa.int64())
            i32 = lambda x: pa.array(x, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), pa.array([field] * len(row), pa.string()), sources.take(take), i32(cols[0]), i32(cols[1]), i32(cols[2]), pa.array(cols[3], pa.string()), pa.array(cols[4], strings), pa.array(cols[5], strings), pa.array(cols[6], pa.list_(pa.float64()))],
                names=names,
            )

    return rows.mapInArrow(run, ISLANDS.format(kind=kind))


def _posterior(islands: DataFrame, by_source: DataFrame | None, share: dict[str, float], model, schema_kind: str) -> DataFrame:
    """The islands with the posterior ``ps`` of every cause (``causes``: none, look-alikes and chains), and the likeliest chain.

    ``chain`` and ``fixed`` are null where the text stands as it is; ``p`` is
    the posterior of all chains together where a chain is likeliest, and of
    none where it is not.
    """
    cols = ["id_", "field_", "source_", "group_", "start_", "end_", "seen", "chains", "texts", "fits"]
    rows = islands.select(*cols)
    if by_source is None:
        rows = rows.withColumn("by_chain", F.lit(None).cast("map<string,double>"))
    else:
        rows = rows.join(by_source, ["source_", "field_"], "left").select(*cols, "by_chain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm: CharModel = model.value
        for batch in batches:
            group, seen, chains, texts, fits, by_chain = (batch.column(i).to_pylist() for i in (3, 6, 7, 8, 9, 10))
            out_c, out_f, out_p, out_l, causes, ps, fixed = [], [], [], [], [], [], []
            for g, s, cs, ts, fs, pr in zip(group, seen, chains, texts, fits, by_chain):
                pr = dict(pr) if pr else {}
                prior = (lambda c: _log_odds(c, pr, share)) if share else (lambda c: PRIOR)
                base = lm.score(s, g)
                names, repairs, scores = [NO_CHAIN], [None], [0.0]
                for c, t, fit in zip(cs, ts, fs):
                    names.append(c)
                    repairs.append(None if c == LOSS else t)
                    # a loss explains its characters, whatever stood there; the rest of the stretch it leaves as it is
                    rest = s.replace(LOST, "")
                    scores.append((lm.score(rest, g) if c == LOSS and rest else 0.0 if c == LOSS else lm.score(t, g)) - base + fit + prior(c))
                top = max(scores)
                weight = [math.exp(x - top) for x in scores]
                total = sum(weight)
                p = [w / total for w in weight]
                real = [k for k, c in enumerate(names) if c not in (NO_CHAIN, LOOKS)]
                wrong = sum(p[k] for k in real)
                # which chain it was: one that restores something, if any of them is as likely as the plain reading
                best = max(real, key=lambda k: (p[k], -k)) if wrong > 0.5 else None
                if best is not None and names[best] == LOSS:
                    whole = [k for k in real if names[k] != LOSS and scores[k] > 0]
                    best = max(whole, key=lambda k: p[k]) if whole else best
                out_l.append(LOST in s)
                out_c.append(names[best] if best is not None else None)
                out_f.append(repairs[best] if best is not None else None)
                out_p.append(wrong if best is not None else p[0])
                causes.append(names)
                ps.append(p)
                fixed.append(repairs)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(7)), pa.array(out_c, pa.string()), pa.array(out_f, pa.string()), pa.array(out_p, pa.float64()), pa.array(out_l, pa.bool_()), pa.array(causes, strings), pa.array(ps, pa.list_(pa.float64())), pa.array(fixed, strings)],
                names=[*cols[:7], "chain", "fixed", "p", "lossy", "causes", "ps", "repairs"],
            )

    return rows.mapInArrow(run, f"id_ {schema_kind}, field_ string, source_ string, group_ int, start_ int, end_ int, seen string, chain string, fixed string, p double, lossy boolean, causes array<string>, ps array<double>, repairs array<string>")


def _chain_counts(scored: DataFrame, clean: DataFrame) -> DataFrame:
    """What the posterior expects of each cause, by source and field: ``by_chain``, a map of a few chains and none."""
    each = F.explode(F.arrays_zip(F.col("causes").alias("chain"), F.col("ps").alias("n"))).alias("x")
    by = scored.select("source_", "field_", each).groupBy("source_", "field_", F.col("x.chain").alias("chain")).agg(F.sum("x.n").alias("n"))
    by = by.unionByName(clean).groupBy("source_", "field_", "chain").agg(F.sum("n").alias("n"))
    return by.groupBy("source_", "field_").agg(F.map_from_entries(F.collect_list(F.struct("chain", "n"))).alias("by_chain"))


def _corpus_share(by_source: DataFrame) -> dict[str, float]:
    """The share of each chain in the corpus; as many entries as there are chains."""
    rows = by_source.select(F.explode("by_chain").alias("chain", "n")).groupBy("chain").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in rows) + 20.0
    return {r.chain: (r.n + 0.5) / total for r in rows}


def _log_odds(chain: str, by_chain: dict[str, float], share: dict[str, float]) -> float:
    """Log prior odds of a chain against none for one source and field, drawn to the corpus by PULL stretches."""
    of = by_chain.get(chain, 0.0) + PULL * share.get(chain, 1e-3)
    return math.log(of / (by_chain.get(NO_CHAIN, 0.0) + PULL * share.get(NO_CHAIN, 0.5)))


def infer(df: DataFrame, fields: tuple[str, ...] = ("text",), id_col: str = "policy_doc_id", source=None, rounds: int = ROUNDS) -> DataFrame:
    """The stretches read in a wrong encoding.

    Columns: the id, ``field``, ``start`` and ``end`` (code points), ``seen``,
    ``chain``, ``fixed`` (null where nothing can be restored), ``p``, ``lossy``.
    ``source`` is the column whose rows share their habits of encoding; by
    default the host of ``url`` where there is such a column.
    """
    spark = df.sparkSession
    if source is None:
        source = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1) if "url" in df.columns else F.lit("")
    kind = df.schema[id_col].dataType.simpleString()
    counts: list[Counter] = [Counter() for _ in GROUPS]
    islands = None
    for field in fields:
        # bounded: a row a code point and group
        for r in char_counts(df, field).toLocalIterator():
            counts[r.group_][chr(r.cp)] += r.n
    model = spark.sparkContext.broadcast(CharModel([dict(c) for c in counts]))
    for field in fields:
        part = extract(df, id_col, field, source, field, model)
        islands = part if islands is None else islands.unionByName(part)
    islands = stage(islands, "encoding-islands")
    by_rows = df.groupBy(F.coalesce(source, F.lit("")).alias("source_")).agg((F.count(F.lit(1)) * CLEAN).alias("n"))
    clean = by_rows.select("source_", F.explode(F.array(*map(F.lit, fields))).alias("field_"), F.lit(NO_CHAIN).alias("chain"), "n")
    by_source, share = None, {}
    for k in range(rounds):
        if k:
            model = spark.sparkContext.broadcast(CharModel([dict(c) for c in counts]))
        scored = _posterior(islands, by_source, share, model, kind)
        if k == rounds - 1:
            break
        scored = stage(scored, "encoding-scored")
        by_source = stage(_chain_counts(scored, clean), "encoding-chains")
        share = _corpus_share(by_source)
        for r in _moved(scored).toLocalIterator():
            counts[r.group_][r.c] += r.n
    found = scored.where(F.col("chain").isNotNull() & (F.col("p") > 0.5))
    return found.select(F.col("id_").alias(id_col), F.col("field_").alias("field"), F.col("start_").alias("start"), F.col("end_").alias("end"), "seen", "chain", "fixed", "p", "lossy")


def _moved(scored: DataFrame) -> DataFrame:
    """What the posterior moves: characters restored count by its weight, garbled ones no longer do by as much. Bounded by the code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str], float] = {}
        for batch in batches:
            for g, seen, ps, repairs, causes in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for p, text, cause in zip(ps, repairs, causes):
                    if cause != NO_CHAIN and p > 1e-6:
                        for c in seen:
                            if cause != LOSS or c == LOST:
                                total[g, c] = total.get((g, c), 0.0) - p
                        for c in text or "":
                            total[g, c] = total.get((g, c), 0.0) + p
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in total], pa.int32()), pa.array([c for _, c in total], pa.string()), pa.array(list(total.values()), pa.float64())], names=["group_", "c", "n"])

    return scored.select("group_", "seen", "ps", "repairs", "causes").mapInArrow(run, "group_ int, c string, n double").groupBy("group_", "c").agg(F.sum("n").alias("n")).where("c is not null and c <> ''")


def repair(df: DataFrame, found: DataFrame, id_col: str = "policy_doc_id", text_col: str = "text") -> DataFrame:
    """The found rows with ``restored``, the text with every stretch replaced that can be, and ``complete``."""
    kind = df.schema[id_col].dataType.simpleString()
    edits = found.where(F.col("field") == text_col).groupBy(F.col(id_col).alias("id_")).agg(F.collect_list(F.struct("start", "end", "fixed", "p")).alias("edits"))
    rows = df.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(edits, "id_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, complete = [], []
            for text, es in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at, whole = [], 0, LOST not in text
                for e in sorted(es, key=lambda e: (e["start"], -(e["end"] - e["start"]), -e["p"])):
                    if e["start"] >= at and e["fixed"] is not None:
                        parts += [text[at : e["start"]], e["fixed"]]
                        at = e["end"]
                out.append("".join([*parts, text[at:]]))
                complete.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(complete)], names=["id_", "restored", "complete"])

    return rows.mapInArrow(run, f"id_ {kind}, restored string, complete boolean").withColumnRenamed("id_", id_col)


#: Characters that next to no clean text holds two of in a row, or beside a control: the mark of a wrong encoding.
_odd = [c for c in _single_bytes("w1252") if 0x80 <= _single_bytes("w1252")[c]]


@lru_cache(None)
def _damage() -> re.Pattern:
    high = _class([c for c in _odd if c not in "’‘“”–—…•«»·©®°ª"])
    near = _class(_odd)
    return re.compile(f"(?:{near}*(?:[{chr(0x80)}-{chr(0x9F)}]|{high}{near}{near}|[ÂÃ]{near}|â{near}){near}*)+|{EAST_RUN}*[{LOST}{chr(0xE000)}-{chr(0xF8FF)}]+(?:{EAST_RUN}|[{LOST}{chr(0xE000)}-{chr(0xF8FF)}])*")


def damaged(text: str) -> list[tuple[int, int]]:
    """The stretches of one text that look read in a wrong encoding, without the corpus: for those who skip them."""
    out = [m.span() for m in _damage().finditer(text)]
    for a, b, chains in candidates(text):
        if b - a >= 2 and any(c.endswith("<utf-8") or c.endswith("twice") for c, _ in chains):
            out.append((a, b))
    out.sort()
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged
