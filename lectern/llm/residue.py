"""Template residue and error-page text (problem 10).

Method: positive-unlabelled naive Bayes by expectation-maximisation. Trusted
are marks that nothing but residue has: the syntax of templates, markers of
dates and fields to be filled in, traces of software, status lines, filler
words and requests to switch scripts on. All other text is unlabelled.

Lines that recur are the passages whose class is latent. Their evidence is
where they stand (alone in a record, beside a trusted passage, in a short
record, in a long one) and their words. Expectation-maximisation first fits the
two distributions of places, those of trusted lines being the start, then words
and places together, until the classes settle. Features are words, punctuation
and single East Asian characters with up to two predecessors; a feature's odds
lean on those of its shorter form where it is rare.

With the settled model every text is scored: a passage is the stretch of a line
with the largest sum of log odds; a record is residue if its best passage
reaches the threshold. Quoted text is left out: what a text only quotes is not
its own. Counts cover all rows. The model is two arrays of ``SIZE`` floats,
whatever the corpus.

Defined results: null, empty and blank texts are never found. Extra columns are
not looked at; repeated rows count as often as they stand.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stage

BITS = 21
SIZE = 1 << BITS
THRESHOLD = 10.0
#: What it costs to start or end amid a sentence.
MIDDLE = 3.0
#: The most rounds; they end when the expected number of residue lines changes by less than SETTLED of it.
ROUNDS, SETTLED = 25, 1e-3
#: A record of at most so many tokens is short; a line that recurs so often has a class.
SHORT, RECURS = 60, 3
#: The share of lines that are residue, at first; occurrences of a line count by this power of their number.
FIRST, DAMPED = 1e-3, 0.5
#: How much the log odds of a line's words weigh beside those of its places.
WORDS = 4.0
LEAN = 2.0
BASE = 1e-3
BLOCK_CHARS = 3_000_000

EAST = "぀-ヿ一-鿿가-힯"
TOKEN = re.compile(rf"\n+|[{EAST}]|[^\W\d_{EAST}]+|\d+|[{{}}]+|\[+|\]+|<+|>+|%+|@+|#+|_+|[^\w\s]")
_inside = lambda end: f"(?:[^{end}\n]|\n(?!\\s*\n))*{end}"
#: A quotation ends within its paragraph; an apostrophe would close single quotes far away, so they hold no line end.
QUOTED = re.compile("|".join((f"“{_inside('”')}", "‘[^’\n]{0,120}’", f"„{_inside('“')}", f"«{_inside('»')}", f"「{_inside('」')}", f"『{_inside('』')}")))
#: Marks of templates, of fields to be filled in, of software, of servers and of filler, with a literal that each holds (empty: a word three times in a row).
TRUSTED = [
    ("{{", r"\{\{[^{}\n]{1,60}\}\}"), ("{%", r"\{%[^%\n]{1,80}%\}"), ("${", r"\$\{[\w.]{2,60}\}"), ("%%", r"%%[\w ]{3,60}%%"), ("@@", r"@@[\w.]{3,60}@@"), ("~~", r"~~[A-Z_]{3,60}~~"),
    ("__", r"__[A-Z]+(?:_[A-Z]+)+__"), (")s", r"%\([\w.]{3,60}\)s"), ("[[", r"\[\[[\w .\-–]{2,60}\]\]"), ("<<", r"<<[A-Z ]{3,60}>>"), ("#", r"#[A-Z]+(?:_[A-Z]+)+#"), ("<", r"<(?:[^\W\d_]+ ){1,4}[^\W\d_]+>"),
    ("[", r"\[(?:INSERT|[Ii]nsert|[Ii]nsertar|[Ii]nserir|[Ii]nsérer|[Yy]our|[Tt]o be) [^\]\n]{2,60}\]"), ("[", r"\[[\w ]{2,40} (?:eintragen|einfügen|ausfüllen)\]"), ("[", r"\[[A-Z]{4,20}\]"),
    ("填写", r"【?请填写[^】\n]{2,20}】?"), ("入力", r"[【\[][^】\]\n]{2,24}入力[^】\]\n]{0,6}[】\]]"), ("記入", r"[【\[][^】\]\n]{2,24}[】\]]を記入"), ("입력", r"[\[(][^\])\n]{1,20}입력[^\])\n]{0,4}[\])]"),
    ("XX", r"\bXX[./]XX[./](?:20)?XX\b"), ("20XX", r"\b20XX\b"), ("○○", r"○○"), ("XX年", r"XX年"), ("TBC", r"\((?:name |date )?TB[CDA]\)"), ("TODO", r"\bTODO:"),
    ("_", r"\b[A-Z]{3,}_[A-Z_]{3,}: \w+\.\w+"), ("<?php", r"<\?php [^\n]{2,80}\?>"), ("<!--", r"<!-- [A-Z]{4,}[^\n]{2,60}-->"), ("[object", r"\[object \w+\]"), ("NaN", r"\bNaN/NaN"), ("#REF!", r"#REF!"), ("=", r"\[\w+(?:[-_]\w+)* \w+=[^\]\n]{1,60}\]"), ("undefined", r"\bundefined,"), ("null (null)", r"null \(null\)"),
    ("Traceback", r"Traceback \(most recent call last\)"), ("Error: ", r"\b[A-Z]\w+Error: [^\n]{1,60}"), ("Undefined", r"Undefined (?:index|variable|offset)"), ("Fatal", r"Fatal error: [^\n]{1,60}"), ("Error!", r"Error! \w[^\n.!]{5,60}\."),
    ("", r"\b([^\W\d_]{2,8})(?: \1){2,}\b"), ("ipsum", r"(?:(?:[Ll]orem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua)[ ,.]+){4,}"),
]


@lru_cache(None)
def _trusted():
    """An automaton over the literals of all trusted patterns, and the patterns by literal."""
    import ahocorasick

    by: dict[str, list[re.Pattern]] = {}
    for key, pattern in TRUSTED:
        by.setdefault(key, []).append(re.compile(pattern))
    automaton = ahocorasick.Automaton()
    for key in by:
        if key:
            automaton.add_word(key, key)
    automaton.make_automaton()
    return automaton, by


#: A tag of markup is no field.
TAGGED = re.compile(r"</?(?:a|b|i|p|br|hr|li|ul|ol|div|span|table|tr|td|th|em|strong)\b")


def trusted_spans(text: str) -> list[tuple[int, int]]:
    """Where trusted passages stand: the literals are looked up all at once, then only their own patterns."""
    automaton, by = _trusted()
    patterns = {p for key in {key for _, key in automaton.iter(text)} for p in by[key]}
    words = text.split()
    same = list(map(eq, words, words[1:]))
    if any(map(and_, same, same[1:])):
        # a word three times in a row
        patterns |= set(by[""])
    return [m.span() for p in patterns for m in p.finditer(text) if not TAGGED.match(m.group())]


class _Ids(dict):
    """A stable 32-bit id by token; digits are one token, lines end in 0."""

    def __missing__(self, token: str) -> int:
        n = 0 if token[0] == "\n" else 1 if token[0].isdigit() else zlib.crc32(token.encode("utf-8", "replace")) | 2
        if len(self) > 400_000:
            self.clear()
        self[token] = n
        return n


_ids = _Ids()
#: What a passage may begin or end with.
EDGES = np.array([0, *(_ids[c * n] for c in "{}[]<>%@#_" for n in (1, 2, 3)), *(_ids[c] for c in ".!?:;()。！？：；、，（）【】")])


_findall = TOKEN.findall


class _Chunks(dict):
    """The ids of a chunk between white space, as bytes; chunks recur."""

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array([_ids[t] for t in _findall(chunk)], dtype=np.int64).tobytes()
        if len(chunk) <= 24:
            if len(self) > 300_000:
                self.clear()
            self[chunk] = ids
        return ids


_chunks = _Chunks()
_split = re.compile(r"[^ \t\r\n\f]+|\n+").findall


def _tokens(text: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(_chunks.__getitem__, _split(text))), dtype=np.int64)


def _parts(text: str) -> Iterator[str]:
    """A very long text in parts, cut at line ends where there are any."""
    while len(text) > BLOCK_CHARS:
        cut = text.rfind("\n", 0, BLOCK_CHARS) + 1 or text.rfind(" ", 0, BLOCK_CHARS) + 1 or BLOCK_CHARS
        yield text[:cut]
        text = text[cut:]
    yield text


def _blocks(batch_texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows with text, a few million characters at a time, quotations blanked."""
    rows, texts, size = [], [], 0
    for k, text in enumerate(batch_texts):
        if not text or text.isspace():
            continue
        for part in _parts(QUOTED.sub(" ", text) if not text.isascii() else text):
            rows.append(k)
            texts.append(part)
            size += len(part)
            if size > BLOCK_CHARS:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


_M = (1 << 62) - 1


def _fold(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> 21) ^ (x >> 42)) & (SIZE - 1)


def _single(ids: np.ndarray) -> np.ndarray:
    """Hashes of each token by itself."""
    return _fold((ids * 0x9E3779B1) & _M)


def _features(ids: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token, with its predecessor, with both predecessors; of the tokens at some places, or of all."""
    at = np.arange(len(ids)) if at is None else at
    one = (ids[at] * 0x9E3779B1) & _M
    before = [(ids[np.maximum(at - k, 0)] * 0x9E3779B1) & _M for k in (1, 2)]
    two = np.where(at > 0, (one ^ ((before[0] * 0x85EBCA6B + 0x1234567) & _M)) & _M, one)
    three = np.where(at > 1, (two ^ ((before[1] * 0xC2B2AE35 + 0x7654321) & _M)) & _M, one)
    return _fold(one), _fold(two + 0x5555), _fold(three + 0xAAAA)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of several texts, each ended by a line end, and where each starts."""
    parts, starts, at = [], [], 0
    end = np.zeros(2, dtype=np.int64)
    for text in texts:
        ids = _tokens(text)
        starts.append(at)
        parts += [ids, end]
        at += len(ids) + 2
    return np.concatenate(parts), np.array(starts)


def _seed_mask(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The token ids of a text and whether each stands in a trusted passage; none without one."""
    spans = trusted_spans(text)
    if not spans:
        return None
    tokens = list(TOKEN.finditer(text))
    at = np.array([m.start() for m in tokens])
    mask = np.zeros(len(tokens), dtype=bool)
    for a, b in spans:
        mask |= (at >= a) & (at < b)
    return np.fromiter((_ids[m.group()] for m in tokens), dtype=np.int64, count=len(tokens)), mask


class Model:
    """Odds of features from counts in all text and in residue."""

    def __init__(self, total: np.ndarray, residue: np.ndarray, words: float, residue_words: float):
        self.total, self.residue = np.maximum(total, residue), residue
        self.base = max(residue_words, 1.0) / max(words, 2.0)
        self.shift = float(np.log(self.base / (1 - self.base)))

    def share(self, ids: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The share of the uses of each token (at some places, or all), in the light of its predecessors, that is residue."""
        p = self.base
        for h in _features(ids, at):
            p = (self.residue[h] + LEAN * p) / (self.total[h] + LEAN)
        return p

    def score(self, ids: np.ndarray) -> np.ndarray:
        """Log odds of each token; line ends break every passage."""
        # a token never seen in residue has not been counted by what stands before it
        s = np.full(len(ids), -8.0)
        at = np.flatnonzero((self.residue[_single(ids)] > 0) & (ids != 0))
        p = np.clip(self.share(ids, at), 1e-7, 1 - 1e-3)
        s[at] = np.clip(np.log(p / (1 - p)) - self.shift, -8.0, 8.0)
        s[ids == 0] = -2000.0
        return s


def passages(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token the best passage that ends there: its sum, and what its start cost.

    A passage that starts or ends amid a sentence, not at a mark, pays MIDDLE for it.
    """
    edge = np.isin(ids, EDGES)
    before = np.concatenate([[0.0], np.cumsum(scores)])
    start = before[:-1].copy()
    start[1:] += np.where(edge[:-1] | edge[1:], 0.0, MIDDLE)
    least = np.minimum.accumulate(start)
    end = np.where(edge | np.append(edge[1:], True), 0.0, MIDDLE)
    return before[1:] - least - end, least


def _gather(df: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Sums of the counts by feature, at most SIZE of them, and the two totals."""
    total, residue, words, residue_words = np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0
    for batch in df.groupBy("h").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).toArrow().to_batches():
        h, n, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        ok = h >= 0
        total[h[ok]], residue[h[ok]] = n[ok], r[ok]
        words += float(n[~ok].sum())
        residue_words += float(r[~ok].sum())
    return total, residue, words, residue_words


def _emit(total: np.ndarray, residue: np.ndarray, words: float, residue_words: float) -> pa.RecordBatch:
    h = np.flatnonzero((total > 0) | (residue > 0))
    return pa.RecordBatch.from_arrays([pa.array(np.append(h, -1)), pa.array(np.append(total[h], words)), pa.array(np.append(residue[h], residue_words))], names=["h", "n", "r"])


COUNTS = "h bigint, n double, r double"
#: Where a line can stand. Beyond these it stands in a long record.
PLACES = ("alone", "beside", "short", "long")
_BLANK = " \t\r\f"
_NUMBER = re.compile("[0-9]+")


def line_key(line: str) -> str:
    """A line as it is compared with others: without white space at its ends, numbers as 0."""
    return _NUMBER.sub("0", line.strip(_BLANK))


ALL_LINES = -2
SEEDS = "h bigint, n double, r double, line string, alone bigint, beside bigint, short bigint, trusted bigint"


def _seeds(df: DataFrame, text_col: str) -> DataFrame:
    """Two kinds of rows: counts of the features of trusted passages, and the lines of short records and beside trusted passages, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        residue, words, lines, n_lines = np.zeros(SIZE), 0.0, {}, 0
        for batch in batches:
            for _, texts in _blocks(batch.column(0).to_pylist()):
                for text in texts:
                    n_lines += sum(1 for x in text.split("\n") if x.strip(_BLANK))
                    found = _seed_mask(text)
                    if found is not None:
                        ids, mask = found
                        for h in _features(ids):
                            np.add.at(residue, h[mask], 1.0)
                        words += mask.sum()
                    short = len(text) < 12 * SHORT and len(_tokens(text)) <= SHORT
                    if not short and found is None:
                        continue
                    rows = [(line_key(x), bool(trusted_spans(x)) if found is not None else False) for x in text.split("\n") if x.strip(_BLANK)]
                    held = [k for k, (_, own) in enumerate(rows) if own]
                    for k, (key, own) in enumerate(rows):
                        near = any(abs(k - j) <= 2 for j in held if j != k)
                        place = 0 if len(rows) == 1 else 1 if near else 2
                        if short or near or own:
                            of = lines.setdefault(key, [0, 0, 0, 0])
                            if short or near:
                                of[place] += 1
                            of[3] += own
        h = np.flatnonzero(residue > 0)
        n, m = len(h) + 2, len(lines)
        none = lambda k, kind: pa.nulls(k, kind)
        # the last two are sums: words in trusted passages, and lines of all texts
        counts = [pa.array(np.append(h, [-1, ALL_LINES])), pa.array(np.append(residue[h], [0.0, n_lines])), pa.array(np.append(residue[h], [words, 0.0]))]
        names = ["h", "n", "r", "line", *PLACES[:3], "trusted"]
        yield pa.RecordBatch.from_arrays([*counts, none(n, pa.string()), *(none(n, pa.int64()) for _ in range(4))], names=names)
        yield pa.RecordBatch.from_arrays([none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64()), pa.array(list(lines), pa.string()), *(pa.array([c[k] for c in lines.values()], pa.int64()) for k in range(4))], names=names)

    return df.select(text_col).mapInArrow(run, SEEDS)


def recurring_lines(df: DataFrame, seeds: DataFrame, text_col: str) -> tuple[DataFrame, list[float], list[float]]:
    """The lines with a class: ``line``, how often it stands at each place, ``trusted``; and how all and the trusted lines fall into the places."""
    lines = seeds.where("line is not null").groupBy("line").agg(*[F.sum(c).alias(c) for c in (*PLACES[:3], "trusted")])
    lines = stage(lines.withColumn("key", F.xxhash64("line")), "residue-lines")
    each = df.where(F.length(text_col) > 0).select(F.explode(F.split(text_col, "\n")).alias("x")).select(F.regexp_replace(F.trim("x", F.lit(_BLANK)), "[0-9]+", "0").alias("x")).where("x <> ''").select(F.xxhash64("x").alias("key"))
    # every line of the corpus counts; only hashes move, summed before
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    all_lines = stage(often.where(F.col("times") >= RECURS), "residue-often")
    n = seeds.where(F.col("h") == ALL_LINES).agg(F.sum("n").alias("n")).first().n or 0
    held = lines.join(all_lines, "key").withColumn("long", F.greatest(F.lit(0), F.col("times") - F.col("alone") - F.col("beside") - F.col("short")))
    of = lambda rows: [float(x or 0) for x in rows.agg(*[F.sum(c) for c in PLACES[:3]]).first()]
    whole = of(lines)
    held = stage(held, "residue-recurring")
    mine = held.where("trusted > 0")
    marked = [*of(mine), float(mine.agg(F.sum("long")).first()[0] or 0)]
    return held, [*whole, max(n - sum(whole), 0.0)], marked


def classify_places(held: DataFrame, whole: list[float], marked: list[float]) -> DataFrame:
    """The lines with ``odds``, the log odds of being residue by where they stand, after expectation-maximisation over all of them."""
    spread = lambda counts: [(c + 1.0) / (sum(counts) + len(counts)) for c in counts]
    of_residue, of_text, prior = spread(marked), spread(whole), FIRST
    before = -1.0
    times = F.col("alone") + F.col("beside") + F.col("short") + F.col("long")
    for _ in range(ROUNDS):
        # occurrences are no independent witnesses: their number counts by a power
        weight = F.pow(times.cast("double"), F.lit(DAMPED - 1.0))
        odds = F.lit(float(np.log(prior / (1 - prior)))) + weight * sum((F.col(c) * F.lit(float(np.log(a / b))) for c, a, b in zip(PLACES, of_residue, of_text)), F.lit(0.0))
        rows = held.withColumn("odds", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds)))
        p = 1 / (1 + F.exp(-F.col("odds")))
        sums = rows.agg(F.sum(p).alias("n"), F.count(F.lit(1)).alias("of"), *[F.sum(p * F.col(c)).alias(c) for c in PLACES]).first()
        if not sums.of or abs((sums.n or 0) - before) <= SETTLED * max(before, 1.0):
            break
        before = sums.n
        of_residue = spread([sums[c] for c in PLACES])
        of_text = spread([max(a - sums[c], 0.0) for c, a in zip(PLACES, whole)])
        prior = min(max(sums.n / sums.of, 1e-4), 0.5)
    return rows


def fit(df: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """The model of residue in the texts of ``df``."""
    ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    seeds = stage(_seeds(df, text_col), "residue-seeds")
    _, trusted, _, trusted_words = _gather(seeds.where(F.col("h") > ALL_LINES).select("h", "n", "r"))
    lines = classify_places(*recurring_lines(df, seeds, text_col)).where("odds > 0").withColumn("times", F.expr("alone + beside + short + long"))
    lines = stage(lines.select("line", "times", "odds"), "residue-classes")

    def weigh(model: Model | None):
        sent = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What the lines add to the counts of residue whose posterior is above a half."""
            residue, words = np.zeros(SIZE), 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                texts, times, odds = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy().copy()
                ids, starts = _joined(texts)
                ends = np.append(starts[1:], len(ids)) - 2
                if sent.value is not None:
                    # which share of the uses of a line's words, with those before them, is residue
                    p = sent.value.share(ids)
                    p = np.array([p[a:b].mean() if b > a else 0.0 for a, b in zip(starts, ends)])
                    odds += WORDS * np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
                joins = np.where(odds > 0, times, 0)
                w = np.zeros(len(ids))
                for a, b, x in zip(starts, ends, joins):
                    w[a:b] = x
                at = w > 0
                for h in _features(ids):
                    np.add.at(residue, h[at], w[at])
                words += w.sum()
            yield _emit(residue, residue, 0.0, words)

        _, residue, _, words = _gather(lines.mapInArrow(run, COUNTS))
        return residue, words

    found, found_words = weigh(None)
    # only features that end in a token seen in residue need counts: all others are ordinary
    ends = sc.broadcast(np.packbits((trusted + found) > 0))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(ends.value)[:SIZE].astype(bool)
        total, words = np.zeros(SIZE), 0.0
        for batch in batches:
            for _, texts in _blocks(batch.column(0).to_pylist()):
                ids, _ = _joined(texts)
                for h in _features(ids, np.flatnonzero(known[_single(ids)])):
                    total += np.bincount(h, minlength=SIZE)
                words += len(ids)
        yield _emit(total, np.zeros(SIZE), words, 0.0)

    total, _, words, _ = _gather(df.select(text_col).mapInArrow(counts, COUNTS))
    model = Model(total, trusted + found, words, trusted_words + found_words)
    for _ in range(rounds):
        before = found_words
        found, found_words = weigh(model)
        model = Model(total, trusted + found, words, trusted_words + found_words)
        if abs(found_words - before) <= SETTLED * max(before, 1.0):
            break
    return model


def score_records(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``score`` of every row: the log odds of its best passage, 0 for rows without text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for rows, texts in _blocks(batch.column(1).to_pylist()):
                ids, starts = _joined(texts)
                best, _ = passages(sent.value.score(ids), ids)
                np.maximum.at(out, rows, np.maximum.reduceat(best, starts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.maximum(out, 0.0))], names=[id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose best passage reaches the threshold, with its ``score``."""
    return score_records(df, fit(df, text_col), id_col, text_col).where(F.col("score") >= threshold)
