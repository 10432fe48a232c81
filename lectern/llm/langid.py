"""Language of documents and of their segments (problem 4).

Method: multilingual mixture inference. Character n-gram models of the
languages are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``) by
expectation-maximisation, so that wrong labels lose their weight. A document is
a mixture: expectation-maximisation over its segments estimates the share of
each language from the n-gram likelihoods, and the set of languages is the one
of least penalised likelihood.

Segments are the running-text paragraphs of the body: lines that end like a
sentence and are neither headings, list items nor table rows; where lines are
wrapped, whole paragraphs. Notices that recur on many pages (of all rows) and
quotations are left out. A document without such paragraphs is judged by all
its lines.

Defined results: null, empty and blank texts have no language. A declared label
that is null or not a spelling of a known language counts as missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: The language of text in none of the label table's.
OTHER = "other"
#: Nats a character by which no language at all has to explain a text better than the best one.
FOREIGN = 0.5
#: The least prior share of a language in a segment.
FLOOR = 1e-3
BITS = 17
SIZE = 1 << BITS
#: The bound of the sample the n-gram models are fitted on.
SAMPLE_ROWS = 8000
ROUNDS = 2
#: Nats a further language costs, and the least share of its own segments a language needs.
PENALTY = 25.0
BLOCK = 500_000
LEAST, SHARE = 4, 6e-4
ITEM = re.compile(r"\s*(?:#{1,6}\s|[-*•–·›»]\s|\d+(?:\.\d+)*[.)]\s|\d+ \||Q:\s)")
ENDS = re.compile(r"[.!?。！？…][”’»\"')\]」』]*\s*$")
QUOTED = re.compile("“[^”]*”|„[^“]*“|«[^»]*»|「[^」]*」|『[^』]*』|‘[^’\n]{0,200}’")
SENTENCE = re.compile(r"(?<=[.!?。！？])[ \t\r]*")


class Sentences:
    """A set of sentences by their hash in Spark."""

    def __init__(self, hashes: set[int]):
        self.hashes = hashes

    def __contains__(self, sentence: str) -> bool:
        n = xxhash.xxh64_intdigest(sentence.encode("utf-8", "surrogatepass"), 42)
        return (n - (1 << 64) if n >> 63 else n) in self.hashes


def notices(df: DataFrame, text_col: str, least: int = LEAST, share: float = SHARE, id_col: str | None = None, url_col: str | None = None) -> tuple[set[int], DataFrame | None]:
    """Hashes of sentences that recur in many texts, at most sentences / support of them, and by ``id_`` those that recur within its host only (``own_``).

    The second support goes by the texts of the host; there is no such table
    without a url, or where the first support is the least one anyway.
    """
    n = df.select(F.lit(1)).count()
    support = max(least, share * n)
    by_host = url_col is not None and support > least
    # in how many texts: a text is told by its longest line, so that copies count once
    own = F.split(text_col, "\n")
    sign = F.xxhash64(F.array_max(F.transform(own, lambda x: F.struct(F.length(x), x))))
    ends = F.filter(own, lambda x: x.rlike("[.!?。！？]"))
    host = F.lower(F.regexp_extract(url_col, "^[A-Za-z]+://([^/?#]+)", 1)) if by_host else F.lit("")
    texts = df.select((F.col(id_col) if id_col else F.lit(0)).alias("id_"), F.xxhash64(F.nullif(host, F.lit(""))).alias("host_"), (F.coalesce(host, F.lit("")) != "").alias("known_"), F.array_distinct(ends).alias("ends_"), sign.alias("ctx"))
    lines = texts.where(F.size("ends_") > 0).select("id_", "host_", "known_", "ctx", F.explode("ends_").alias("line"))
    marked = F.regexp_replace("line", "([.!?。！？])[ \t\r]*", "$1\n")
    rows = lines.select("id_", "host_", "known_", "ctx", F.explode(F.split(marked, "\n")).alias("line")).withColumn("line", F.trim("line")).where(F.col("line").rlike("^.{4,}[.!?。！？]$"))
    # the texts are cut once; what is counted are hashes
    rows = stage(rows.withColumn("line", F.xxhash64("line")), "notices-lines") if by_host else rows.withColumn("line", F.xxhash64("line"))
    kept = rows.groupBy("line", "ctx").agg(F.lit(1).alias("one")).groupBy("line").count().where(F.col("count") >= support).select("line")
    everywhere = {r.line for r in kept.toLocalIterator()}
    if not by_host:
        return everywhere, None
    sizes = texts.groupBy("host_").agg(F.count(F.lit(1)).alias("of"))
    within = rows.where("known_").groupBy("host_", "line", "ctx").agg(F.lit(1).alias("one")).groupBy("host_", "line").count().where(F.col("count") >= least)
    within = stage(within.join(sizes, "host_").where(F.col("count") >= F.greatest(F.lit(least), share * F.col("of"))).select("host_", "line"), "notices-own")
    return everywhere, rows.where("known_").join(within, ["host_", "line"]).groupBy("id_").agg(F.collect_set("line").alias("own_"))


def segments(text: str, wrapped: bool, skip: Sentences) -> list[tuple[int, str, bool]]:
    """All units of the paragraphs as (number of paragraph, text, whether it is running text of the body)."""
    out = []
    para, blank = -1, True
    parts: dict[int, list[str]] = {}
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            blank = True
            continue
        para += blank
        blank = False
        parts.setdefault(para, []).append(s)
    for no, lines in parts.items():
        if wrapped and not any(map(ITEM.match, lines)):
            units = [" ".join(lines)]
        else:
            units = lines
        for s in units:
            running = bool(ENDS.search(s)) and not ITEM.match(s)
            if running:
                own = [x for x in SENTENCE.split(s) if x and x not in skip and "©" not in x]
                if not own:
                    # a notice: a segment, but no part of the body
                    out.append((no, s, None))
                    continue
                s = " ".join(own)
                running = bool(ENDS.search(s)) and (len(s) >= 60 or not s.isascii() and len(s) >= 18)
            out.append((no, s, running))
    return out


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the units, lower-cased, digits as spaces, a line end between; and where each starts."""
    joined = "\n".join(QUOTED.sub(" ", u) if not u.isascii() else u for u in units) + "\n"
    c = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.flatnonzero(c == 10)
    return c, np.concatenate([[0], ends[:-1] + 1])


def _grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-grams and single characters at each place."""
    c = np.where((c < 65) & (c != 10), 32, c).astype(np.uint32)
    one = (c * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    three = c * np.uint32(2246822519)
    three[1:] += c[:-1] * np.uint32(3266489917)
    three[2:] += c[:-2] * np.uint32(668265263)
    three = (three ^ (three >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    return three, one


class NGrams:
    """Log probabilities of hashed n-grams by language, against their mean; the last column is no language, in which all are equally likely."""

    def __init__(self, three: np.ndarray, one: np.ndarray):
        self.tables, self.n = [], len(three)
        for counts in (three, one):
            p = np.log((counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * 4096))
            p = np.concatenate([p, np.full((1, SIZE), -np.log(SIZE if counts is three else 4096))])
            self.tables.append(np.ascontiguousarray((p - p[:-1].mean(axis=0)).T.astype(np.float32)) if self.n else np.zeros((SIZE, 1), dtype=np.float32))

    def score(self, units: list[str]) -> np.ndarray:
        """Log likelihood of each unit by language."""
        out = np.zeros((len(units), self.n + 1))
        block, owner, size = [], [], 0

        def flush() -> None:
            c, starts = _codes(block)
            three, one = _grams(c)
            s = self.tables[0][three]
            s += self.tables[1][one]
            np.add.at(out, owner, np.add.reduceat(s, starts, axis=0)[: len(block)])

        for k, unit in enumerate(units):
            # a very long unit in parts
            for at in range(0, max(1, len(unit)), BLOCK):
                part = unit[at : at + BLOCK].replace("\n", " ")
                if block and size + len(part) > BLOCK:
                    flush()
                    block, owner, size = [], [], 0
                block.append(part)
                owner.append(k)
                size += len(part)
        if block:
            flush()
        return out


def spellings(labels: DataFrame) -> tuple[dict[str, str], list[str]]:
    """The language each spelling stands for, and the languages; a table of a few names."""
    lang_of = {r.spelling: r.lang for r in labels.where("spelling is not null and lang is not null").select("spelling", "lang").collect()}
    return lang_of, sorted(set(lang_of.values()))


def fit(df: DataFrame, lang_of: dict[str, str], langs: list[str], id_col: str, text_col: str, declared_col: str, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> NGrams:
    """The n-gram models, from at most about ``sample_rows`` rows with a known label."""
    spark = df.sparkSession
    place = {x: k for k, x in enumerate(langs)}
    if not langs:
        return NGrams(np.zeros((0, SIZE)), np.zeros((0, SIZE)))
    labelled = df.where(F.col(declared_col).isin(list(lang_of))).select(id_col, text_col, declared_col)
    n = labelled.select(F.lit(1)).count()
    if n > sample_rows:
        labelled = labelled.where(F.expr(f"pmod(xxhash64(`{id_col}`), 1000003)") < int(1000003 * sample_rows / n))
    labelled = labelled.where(F.length(text_col) > 0)
    model = None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model, lang_of))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, lang_of = sent.value
            counts = np.zeros((2, len(langs), SIZE))
            for batch in batches:
                texts, declared = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                units, label = [], []
                for text, spelling in zip(texts, declared):
                    for line in text.split("\n"):
                        if len(line) > 20:
                            units.append(line)
                            label.append(place[lang_of[spelling]])
                label = np.array(label, dtype=int)
                if model is not None and len(units):
                    s = model.score(units)[:, : len(langs)]
                    # the label is one more witness
                    s[np.arange(len(units)), label] += 5.0
                    label = s.argmax(axis=1)
                for k in np.unique(label):
                    own = [units[i] for i in np.flatnonzero(label == k)]
                    for at in range(0, len(own), 2000):
                        c, _ = _codes(own[at : at + 2000])
                        for j, g in enumerate(_grams(c)):
                            counts[j, k] += np.bincount(g, minlength=SIZE)
            j, k, h = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(k), pa.array(h), pa.array(counts[j, k, h])], names=["j", "k", "h", "n"])

        counts = np.zeros((2, len(langs), SIZE))
        for batch in labelled.mapInArrow(run, "j bigint, k bigint, h bigint, n double").groupBy("j", "k", "h").agg(F.sum("n").alias("n")).toArrow().to_batches():
            j, k, h, n = (batch.column(i).to_numpy() for i in range(4))
            counts[j, k, h] = n
        model = NGrams(counts[0], counts[1])
    return model


def mixture(scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The share of each language in one document, the posterior of each segment, and the languages chosen.

    The last column of the scores is no language at all; it stands only where it
    is better by FOREIGN nats a character.
    """
    x = scores.copy()
    x[:, -1] -= FOREIGN * lengths
    # from all languages that are any segment's best, drop the one whose loss costs least, while that is below the penalty
    chosen = sorted(set(x.argmax(axis=1).tolist()))
    best = x[:, chosen].max(axis=1).sum()
    while len(chosen) > 1:
        losses = [(best - x[:, [c for c in chosen if c != k]].max(axis=1).sum(), k) for k in chosen]
        loss, k = min(losses)
        if loss >= PENALTY:
            break
        chosen.remove(k)
        best -= loss
    share = np.zeros(x.shape[1])
    share[chosen] = 1 / len(chosen)
    w = lengths / lengths.sum()
    for _ in range(20):
        r = _responsible(x, share)
        new = w @ r
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, r, chosen


def _responsible(x: np.ndarray, share: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        s = x + np.log(share)
    s -= s.max(axis=1, keepdims=True)
    r = np.exp(s)
    return r / r.sum(axis=1, keepdims=True)


def detect(df: DataFrame, labels: DataFrame, id_col: str = "policy_doc_id", text_col: str = "text", declared_col: str = "language_declared", wrapped_col: str | None = "extension", by_segment: bool = False, url_col: str = "url") -> DataFrame:
    """The languages of each row with text, by falling share.

    Columns: the id, ``lang``, ``share`` of the body, ``confidence``,
    ``n_paras`` (whole running-text paragraphs), ``main``, ``declared`` (the
    language the label stands for, null if none). With ``by_segment`` a row is
    a run of lines of one paragraph in one language: the id, ``para_no``,
    ``segment_no`` within the paragraph, ``lang`` and ``confidence``; every
    paragraph has one at least.
    """
    lang_of, langs = spellings(labels)
    model = fit(df, lang_of, langs, id_col, text_col, declared_col)
    everywhere, own = notices(df, text_col, id_col=id_col, url_col=url_col if url_col in df.columns else None)
    names = [*langs, OTHER]
    sent = df.sparkSession.sparkContext.broadcast((model, everywhere, lang_of))
    kind = df.schema[id_col].dataType.simpleString()
    wrapped = F.lower(F.col(wrapped_col)) == "pdf" if wrapped_col else F.lit(False)
    rows = df.where(F.length(text_col) > 0).select(id_col, text_col, declared_col, F.coalesce(wrapped, F.lit(False)).alias("wrapped_"))
    rows = rows.join(own.withColumnRenamed("id_", id_col), id_col, "left") if own is not None else rows.withColumn("own_", F.lit(None).cast("array<bigint>"))

    def judge(batch: pa.RecordBatch):
        """By row: its place, declared language, whether it has running text, its units, their scores, and its mixture."""
        model, skip, lang_of = sent.value
        texts, declared, wrapped, further = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
        units, owner = [], []
        for k, text in enumerate(texts):
            found = segments(text, wrapped[k], Sentences(skip.union(further[k]) if further[k] else skip))
            whole = any(running for *_, running in found)
            if not found and text.strip():
                found = [(0, text, False)]
            # what the document is judged by; the rest only where every segment is asked for
            judged = [running is whole for *_, running in found]
            if not any(judged):
                judged = [True] * len(found)
            for (no, s, _), own in zip(found, judged):
                if own or by_segment:
                    units.append(s)
                    owner.append((k, no, own, whole))
        scores = model.score(units).astype(float)
        lengths = np.array([len(u) for u in units], dtype=float)
        first = 0
        for last in range(1, len(units) + 1):
            if last == len(units) or owner[last][0] != owner[first][0]:
                k, _, _, whole = owner[first]
                at = np.flatnonzero([own for _, _, own, _ in owner[first:last]]) + first
                yield k, lang_of.get(declared[k]), whole, [no for _, no, _, _ in owner[first:last]], scores[first:last], lengths[first:last], at - first, mixture(scores[at], lengths[at])
                first = last

    if by_segment:

        def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, para, seg, lang, conf = [], [], [], [], []
                for k, _, _, nos, x, lengths, _, (share, _, _) in judge(batch):
                    x = x.copy()
                    x[:, -1] -= FOREIGN * lengths
                    best = _responsible(x, np.maximum(share, FLOOR)).argmax(axis=1)
                    at = 0
                    for end in range(1, len(nos) + 1):
                        if end == len(nos) or nos[end] != nos[at] or best[end] != best[at]:
                            r = _responsible(x[at:end].sum(axis=0, keepdims=True), np.maximum(share, FLOOR))[0]
                            seg.append(seg[-1] + 1 if row and row[-1] == k and para[-1] == nos[at] else 0)
                            row.append(k)
                            para.append(nos[at])
                            lang.append(names[best[at]])
                            conf.append(float(r[best[at]]))
                            at = end
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(para, pa.int32()), pa.array(seg, pa.int32()), pa.array(lang, pa.string()), pa.array(conf, pa.float64())], names=["id_", "para_no", "segment_no", "lang", "confidence"])

        return rows.mapInArrow(segment_rows, f"id_ {kind}, para_no int, segment_no int, lang string, confidence double").withColumnRenamed("id_", id_col)

    def document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cols = [], [[] for _ in range(6)]
            for k, declared, whole, _, scores, lengths, at, (share, r, chosen) in judge(batch):
                scores, lengths = scores[at], lengths[at]
                best = r.argmax(axis=1)
                top = int(share.argmax())
                if len(langs) > 1:
                    known = scores[:, :-1]
                    margin = (known.max(axis=1) - np.partition(known, -2, axis=1)[:, -2]) / np.maximum(lengths, 1)
                else:
                    margin = np.full(len(lengths), np.inf)
                for l in sorted(chosen, key=lambda l: -share[l]):
                    own = best == l
                    n = int(own.sum()) if whole else 0
                    if l != top and not (n and (l == len(langs) or _is_whole(margin[own], lengths[own]))):
                        continue
                    row.append(k)
                    for col, x in zip(cols, (names[l], float(share[l]), float(r[own, l].mean()) if own.any() else 0.0, n, l == top, declared)):
                        col.append(x)
            types = (pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id_", "lang", "share", "confidence", "n_paras", "main", "declared"])

    return rows.mapInArrow(document_rows, f"id_ {kind}, lang string, share double, confidence double, n_paras int, main boolean, declared string").withColumnRenamed("id_", id_col)


def _is_whole(margin: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether some paragraph stands in the language as a whole: it leads by far more than a quotation would."""
    return bool(((margin > 0.12) & (margin * lengths > PENALTY)).any())


def mislabelled(detected: DataFrame, id_col: str = "policy_doc_id") -> DataFrame:
    """The rows whose label is missing or wrong, or that hold several languages: the id and ``lang``. Text in no known language has none to give."""
    detected = detected.where(F.col("lang") != OTHER)
    main = F.max_by("lang", F.struct("main", "share"))
    cases = detected.groupBy(id_col).agg(main.alias("main_"), F.max("declared").alias("declared_"), F.collect_set("lang").alias("langs_"))
    return cases.where("declared_ is null or declared_ <> main_ or size(langs_) > 1").select(id_col, F.explode("langs_").alias("lang"))
