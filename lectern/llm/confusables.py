"""One consistent form for text that only looks the same (problem 7).

Method: confusables skeleton. A word is decomposed, every character is replaced
by the prototype of its look-alikes (full-width, mathematical and other
compatibility forms by their decomposition, look-alikes of other scripts and
signs by table and by name), characters that cannot be seen are dropped, and
the result is decomposed again. Originals of the corpus with the same skeleton
are one word. Its ordinary form is the commonest of those its members come to
in their own script, counted over all texts; every member in another form than
an ordinary one of its script is a variant of it.

A form is ordinary if it is composed, has no compatibility form of a letter,
digit or space, nothing invisible, and no look-alike of another script beside
Latin letters (or Latin beside that script). Whole Greek, Cyrillic, Armenian,
Cherokee and Coptic words, single such symbols, East Asian punctuation,
typographic quotes and dashes, form feeds, ordinals, superscripts and symbols
stay. Characters inside a stretch read in a wrong encoding are not looked at.

Defined results: null stays null, empty and blank text stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .lookalikes import BY_NAME, CYRILLIC, GREEK, LATIN, LOOKALIKE, PROTOTYPE, RANGES

span = lambda a, b: f"{chr(a)}-{chr(b)}"
#: Characters without a glyph.
INVISIBLE = chr(0xAD) + chr(0x34F) + chr(0x61C) + chr(0x180E) + span(0x200B, 0x200F) + span(0x202A, 0x202E) + span(0x2060, 0x2064) + span(0x2066, 0x206F) + chr(0xFEFF) + span(0xE0000, 0xE007F)
#: Spaces other than U+0020.
SPACES = chr(0xA0) + chr(0x1680) + span(0x2000, 0x200A) + chr(0x202F) + chr(0x205F) + chr(0x3000)
#: Blocks of letters and digits in a form other than the ordinary one.
FORMS = (
    span(0xFF10, 0xFF19) + span(0xFF21, 0xFF3A) + span(0xFF41, 0xFF5A) + span(0xFF66, 0xFFDC) + span(0x1D400, 0x1D7FF) + span(0xFB00, 0xFB06) + span(0x2E80, 0x2FD5)
    + span(0x1100, 0x11FF) + span(0x3131, 0x318E) + span(0xA960, 0xA97C) + span(0xD7B0, 0xD7FB) + span(0x2100, 0x2101) + span(0x210A, 0x2115) + span(0x2119, 0x211D) + span(0x2460, 0x24FF)
    + span(0x1F100, 0x1F189) + span(0xF900, 0xFAFF) + span(0x132, 0x133) + span(0x1C4, 0x1CC) + span(0x1F1, 0x1F3) + chr(0x17F) + chr(0x2071) + chr(0x207F) + span(0x2090, 0x209C)
)
MARKS = span(0x300, 0x36F) + chr(0x3099) + chr(0x309A) + span(0x1AB0, 0x1AFF) + span(0x1DC0, 0x1DFF)
OTHERS = "".join(span(a, b) for a, b in RANGES)
DRAWN = "".join({**LATIN, **BY_NAME})
LATIN_LETTERS = "A-Za-z" + span(0xAA, 0xAA) + span(0xC0, 0xD6) + span(0xD8, 0xF6) + span(0xF8, 0x24F) + span(0x1E00, 0x1EFF)
SUSPECT = re.compile(f"[{INVISIBLE}{SPACES}{FORMS}{MARKS}{OTHERS}{DRAWN}]")
HARD = re.compile(f"[{FORMS}]")
MARKED = re.compile(f"[^ \t\r\n\f][{MARKS}]")
HIDDEN = re.compile(f"[{INVISIBLE}]+")
SPACE = re.compile(f"[{SPACES}]")
LETTERS = re.compile(f"[{LATIN_LETTERS}{OTHERS}{INVISIBLE}{MARKS}{span(0x1D400, 0x1D7FF)}{span(0xFF21, 0xFF3A)}{span(0xFF41, 0xFF5A)}{DRAWN}]+")
HAS_LATIN = re.compile(f"[{LATIN_LETTERS}{span(0x1D400, 0x1D7FF)}{span(0xFF21, 0xFF3A)}{span(0xFF41, 0xFF5A)}]")
HAS_OTHER = re.compile(f"[{OTHERS}{DRAWN}]")
#: A Latin letter read back as the Greek or Cyrillic letter it passes for.
TO_CYRILLIC = {b: a for a, b in CYRILLIC.items() if a not in LATIN}
TO_GREEK = {b: a for a, b in GREEK.items() if a not in LATIN}


def prototype(c: str) -> str:
    """The prototype of a character: what all its look-alikes share."""
    if HIDDEN.match(c):
        return ""
    if SPACE.match(c):
        return " "
    if HARD.match(c):
        c = unicodedata.normalize("NFKD", c)
    return "".join(PROTOTYPE.get(x, x) for x in c)


_known: dict[str, str] = {}


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again."""
    out = []
    for c in unicodedata.normalize("NFD", text):
        p = _known.get(c)
        if p is None:
            p = _known[c] = prototype(c)
        out.append(p)
    return unicodedata.normalize("NFD", "".join(out))


def _script(c: str) -> int | None:
    """The place in RANGES of a letter of another script, none for others."""
    n = ord(c)
    return next((k for k, (a, b) in enumerate(RANGES) if a <= n <= b), None)


def _ordinary_letters(m: re.Match) -> str:
    """A run of letters of Latin and other scripts in one script, if look-alikes of another stand in it."""
    run = m.group()
    if not HAS_OTHER.search(run):
        return run
    own = [c for c in run if _script(c) is not None]
    strange = [c for c in own if c not in LOOKALIKE]
    if not HAS_LATIN.search(run):
        scripts = {_script(c) for c in own}
        if len(scripts) > 1 and not strange:
            # look-alikes of several scripts, and no letter that only one of them has: a Latin word
            return "".join(LOOKALIKE.get(c, c) for c in run)
        return "".join(LATIN.get(c, BY_NAME.get(c, c)) for c in run) if own or len(run) > 1 else run
    if strange and len(own) > len(run) - len(own):
        # a Greek or Cyrillic word with a Latin letter or two in it
        table = TO_GREEK if sum(_script(c) == 0 for c in own) * 2 > len(own) else TO_CYRILLIC
        return "".join(table.get(c, c) for c in run)
    return "".join(LOOKALIKE.get(c, c) for c in run)


def ordinary(text: str) -> str:
    """The text in its one consistent form."""
    if not SUSPECT.search(text):
        return text
    text = HIDDEN.sub("", text)
    text = SPACE.sub(" ", text)
    text = HARD.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = unicodedata.normalize("NFC", text)
    return LETTERS.sub(_ordinary_letters, text)


def _masked(text: str) -> str:
    """The text with the stretches blanked whose characters stem from a wrong encoding."""
    from .mojibake import damaged

    out, at = [], 0
    for a, b in damaged(text):
        out += [text[at:a], "�" * (b - a)]
        at = b
    return "".join([*out, text[at:]])


EDGE = re.compile(f"(?:^|(?<=�))[{INVISIBLE}{SPACES}{MARKS}]+|[{INVISIBLE}{SPACES}{MARKS}]+(?=�)")


def suspects(text: str) -> list[tuple[str, str]]:
    """The words of a text that hold a character with look-alikes, and what each comes to in its own script."""
    if text.isascii() or not SUSPECT.search(text):
        return []
    clean = EDGE.sub("", _masked(text))
    out = []
    # words as they were, and the spaces between them
    for word in re.split("[ \t\r\n\f]+", clean):
        if SUSPECT.search(word):
            plain = ordinary(word)
            if plain == word or word.strip("".join(_blank)) or len(word) == 0:
                out.append((word, plain))
    return out


def variants(text: str) -> list[tuple[str, str]]:
    """The words of one text in another form than the ordinary one of their script, with that one; without the corpus."""
    return [(word, plain) for word, plain in suspects(text) if word != plain]


_blank = [chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x2010), 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0xAD)]
#: Words to look for are broadcast up to so many, and joined beyond.
BROADCAST_WORDS = 200_000


def word_variants(df: DataFrame, id_col: str = "policy_doc_id", text_col: str = "text") -> DataFrame:
    """A row a variant word: the id, ``form``, ``skeleton`` and ``ordinary``; words in their ordinary form give none.

    A text in plain ASCII has no variant and does not reach Python.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, text_col).where(F.octet_length(text_col) > F.length(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, form, bone, plain = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for word, better in suspects(text):
                    a, b = skeleton(word), skeleton(better)
                    if a == b:
                        row.append(k)
                        form.append(word)
                        bone.append(a)
                        plain.append(better)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(form, pa.string()), pa.array(bone, pa.string()), pa.array(plain, pa.string())], names=["id_", "form", "skeleton", "plain"])

    words = stage(rows.mapInArrow(run, f"id_ {kind}, form string, skeleton string, plain string"), "look-words")
    # groups of equal skeleton with a variant in them; how common each candidate is, over all texts
    wanted = stage(words.where("form <> plain").select("skeleton", "plain").distinct(), "look-candidates")
    few = wanted.select(F.lit(1)).limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    each = df.where(F.col(text_col).isNotNull()).select(F.explode(F.split(text_col, "[ \t\r\n\f]+")).alias("plain")).where("plain <> ''")
    plain = wanted.select("plain").distinct()
    seen = each.join(F.broadcast(plain) if few else plain, "plain", "left_semi").groupBy("plain").agg(F.count(F.lit(1)).alias("n"))
    ranked = wanted.join(seen, "plain", "left").groupBy("skeleton").agg(F.max_by("plain", F.struct(F.coalesce("n", F.lit(0)), -F.length("plain"), "plain")).alias("ordinary"))
    found = words.where("form <> plain").join(F.broadcast(ranked) if few else ranked, "skeleton").where("form <> ordinary")
    return found.select(F.col("id_").alias(id_col), "form", "skeleton", "ordinary")


def skeleton_groups(variants_: DataFrame, id_col: str = "policy_doc_id") -> DataFrame:
    """The variant words by skeleton: ``ordinary``, ``n_forms`` and ``n_words``, the latter summed before any word moves."""
    by_form = variants_.groupBy("skeleton", "ordinary", "form").agg(F.count(F.lit(1)).alias("n"))
    return by_form.groupBy("skeleton").agg(F.min("ordinary").alias("ordinary"), F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_words"))


def normalize(df: DataFrame, id_col: str = "policy_doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with ``normalized``, its text in one consistent form; null stays null."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x if x is None or x.isascii() else ordinary(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "normalized"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, normalized string")
