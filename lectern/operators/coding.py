"""Prompts and coders: the text around a passage, and what turns it into labels."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import THEMES, USES

BATCH = 32
#: Words by theme for the coder that needs no model.
KEYWORDS = {
    "T1_integration": ("integrat", "curricul"), "T2_multimodal": ("image", "video", "audio", "voice"), "T3_privacy": ("personal data", "privacy", "retention"), "T4_integrity": ("misconduct", "plagiarism", "ghost-written"),
    "T5_disclosure": ("disclosure", "acknowledg", "usage statement"), "T6_equity": ("assistive", "screen-reader", "hardship", "free licence"), "T7_vendor_governance": ("vendor", "supplier", "procurement", "audit"), "T8_pedagogical_redesign": ("redesign", "portfolio", "in-class"),
}


def fenced(markdown: str) -> Iterator[tuple[str, list[str]]]:
    """Every fenced block of a document with the heading it stands under."""
    heading, block = "", None
    for line in markdown.splitlines():
        fence = line.lstrip().startswith("```")
        if block is None and fence:
            block = []
        elif fence:
            yield heading, block
            block = None
        elif block is not None:
            block.append(line)
        elif line.startswith("#"):
            heading = line.strip()


#: The headings of a codebook and the marks within its examples.
SYSTEM_HEADING, EXAMPLE_HEADING, TEXT_MARK, EXPECTED_MARK = "## System prompt", "### Example ", "TEXT", "EXPECTED OUTPUT"


def template(markdown: str) -> tuple[str, list[dict[str, str]]]:
    """System text and worked examples of a codebook: the first block under the system heading, and blocks of examples with both marks."""
    system, examples = None, []
    for heading, lines in fenced(markdown):
        marks = [x.strip() for x in lines]
        if heading == SYSTEM_HEADING and system is None:
            system = "\n".join(lines).strip()
        elif heading.startswith(EXAMPLE_HEADING) and TEXT_MARK in marks and EXPECTED_MARK in marks:
            at, end = marks.index(TEXT_MARK), marks.index(EXPECTED_MARK)
            examples.append({"text": _unquoted("\n".join(lines[at + 1 : end])), "expected": _one_line("\n".join(lines[end + 1 :]))})
    return system or "", examples


def _unquoted(text: str) -> str:
    return re.sub(r'^[\s"]+|[\s"]+$', "", text)


def _one_line(text: str) -> str:
    """JSON on one line; what is no JSON stays as it is."""
    from contextlib import suppress

    with suppress(ValueError):
        return json.dumps(json.loads(text), ensure_ascii=False)
    return text.strip()


#: The frame of a prompt, its defaults and how much of a text goes in.
OPENING = ("Below are 16 example codings, followed by the chunk you must code.", "Output one JSON object only.", "")
PASSAGE_OPENING = "NOW CODE THE FOLLOWING:"
SECTION, LANGUAGE, CHUNK = "Document section: ", "Original language: ", "Chunk ID: "
CLOSING = ("", "JSON output only:")
EXAMPLE_CHARS, PASSAGE_CHARS = 600, 6000


def prompt(examples: list[dict[str, str]] | None = None) -> Column:
    """The prompt of a passage: examples, what is known of the passage, its text. Missing cells read ``?``."""
    some = lambda c, other="?": F.coalesce(F.col(c), F.lit(other))
    shown = [line for k, x in enumerate(examples or [], 1) for line in (f"EXAMPLE {k}", f"Text: {x['text'][:EXAMPLE_CHARS]}", f"Expected: {x['expected']}", "")]
    about = [
        F.concat(F.lit("University: "), some("institution_name"), F.lit(" ("), some("region"), F.lit(", tier "), some("tier"), F.lit(")")),
        F.concat(F.lit(SECTION), some("section_header", "unknown")), F.concat(F.lit(LANGUAGE), some("language_declared")), F.concat(F.lit(CHUNK), some("chunk_id")), F.lit(""), F.lit("Text:"), F.substring(some("text", ""), 1, PASSAGE_CHARS),
    ]
    return F.concat_ws("\n", *map(F.lit, (*OPENING, *shown, PASSAGE_OPENING)), *about, *map(F.lit, CLOSING))


def keyword_coder(texts: list[str]) -> list[str]:
    """A coder without a model: a theme is coded if one of its words occurs; sentiment stays silent."""
    out = []
    for text in texts:
        low = (text or "").lower()
        themes = {t: int(any(w in low for w in KEYWORDS[t])) for t in THEMES}
        out.append(json.dumps({"themes": themes, "sentiment": {u: 0 for u in USES}, "confidence": "low", "notes": ""}))
    return out


def code_passages(df: DataFrame, coder: Callable[[list[str]], list[str]] = keyword_coder, id_col: str = "chunk_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """Every passage with ``raw``, the coder's answer, made in batches by each worker; a null text is coded as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw: list[str] = []
            texts = [x or "" for x in f["text_"]]
            for at in range(0, len(texts), batch):
                raw += coder(texts[at : at + batch])
            yield pd.DataFrame({id_col: f[id_col], "raw": raw})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("text_")).mapInPandas(run, f"`{id_col}` {kind}, raw string")
