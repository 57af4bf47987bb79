"""Tokens per section from one encoding of the whole text.

A text is encoded once; each token has a span of characters. The spans are joined by
interval with the text's sections, so a section's count is what it has within its context
and the counts of a text add up to its own. A token over a border goes by rule to

* ``start``: the section of its first character,
* ``end``: the section of its last character,
* ``majority``: the section that holds most of its characters, of equal ones the earlier.

A token that begins or ends inside a character covers that character. Characters of no
section, if sections are given, belong to section -1, which has a row where it has tokens.
Lines are the sections if none are given: each with its line feed; an empty or null text is
one empty line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _bytes, decoder, encoder, slices

RULES = ("start", "end", "majority")


def with_fields(rows: DataFrame, fields: list[str], text: str = "text", sections: str = "sections", joint: str = "\n") -> DataFrame:
    """Fields joined to one text, and where each stands in it; null fields count as empty.

    Columns named ``text`` and ``sections`` are replaced.
    """
    parts = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    at, spans = F.lit(0), []
    for part in parts:
        spans.append(F.struct(at.alias("start"), (at + F.length(part)).alias("end")))
        at = at + F.length(part) + len(joint)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (text, sections)]
    return rows.select(*kept, F.concat_ws(joint, *parts).alias(text), F.array(*spans).alias(sections))


def _lines(raw: np.ndarray, lens: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first and one-past-last character of every line of texts set end to end."""
    stops = np.cumsum(lens)
    after = np.flatnonzero(raw == 10) + 1
    owner = np.searchsorted(stops, after, "right")
    inside = after < stops[np.minimum(owner, len(lens) - 1)] if len(lens) else after[:0]
    inside &= after > (stops - lens)[np.minimum(owner, len(lens) - 1)] if len(lens) else inside
    text = np.concatenate([np.arange(len(lens)), owner[inside]])
    first = np.concatenate([stops - lens, after[inside]])
    order = np.lexsort((first, text))
    text, first = text[order], first[order]
    end = np.empty(len(first), np.int64)
    end[:-1], last = first[1:], np.flatnonzero(np.diff(text, append=-1))
    end[last] = stops[text[last]]
    return text, chars[first], chars[end]


def _given(sections: pa.Array, first_char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sections = pc.fill_null(sections, pa.scalar([], sections.type)) if sections.null_count else sections
    flat, text = sections.flatten(), np.repeat(np.arange(len(sections)), pc.list_value_length(sections).to_numpy())
    start = flat.field("start").to_numpy().astype(np.int64) + first_char[text]
    end = flat.field("end").to_numpy().astype(np.int64) + first_char[text]
    return text, start, end


def _section(at: np.ndarray, start: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The section that holds each character, or -1."""
    if not len(order):
        return np.full(len(at), -1)
    n = order[np.maximum(np.searchsorted(start[order], at, "right") - 1, 0)]
    return np.where((start[n] <= at) & (at < end[n]), n, -1)


def attribute(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", sections: str | None = None, rule: str = "majority") -> DataFrame:
    """Rows (key, section, start, end, n_tokens, n_crossing): characters and tokens per section.

    ``sections`` names a column of (start, end) spans of characters that do not overlap.
    ``n_crossing`` counts the section's tokens that reach over its border.
    """
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")
    source = docs.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), *([F.col(f"`{sections}`").alias("sections")] if sections else [])
    )
    kind = docs.schema[key].dataType
    names = [(key, kind), ("section", T.IntegerType())] + [(n, T.LongType()) for n in ("start", "end", "n_tokens", "n_crossing")]
    schema = T.StructType([T.StructField(n, k) for n, k in names])

    def run(batches):
        enc, size = encoder(path, pattern), decoder(path).size
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                ids, _ = enc.column(texts)
                raw, lens = _bytes(texts)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
                stops = np.cumsum(size[ids])
                first = chars[stops - size[ids] + 1] - 1
                last = chars[stops] - 1
                first_char = chars[np.cumsum(lens) - lens]
                if sections:
                    owner, start, end = _given(part.column("sections"), first_char)
                else:
                    owner, start, end = _lines(raw, lens, chars)
                some = np.flatnonzero(end > start)
                order = some[np.argsort(start[some], kind="stable")]
                a, b = _section(first, start, end, order), _section(last, start, end, order)
                chosen = (b if rule == "end" else a).copy()
                if rule == "majority":
                    for t in np.flatnonzero(a != b):
                        span = np.arange(first[t], last[t] + 1)
                        held, times = np.unique(_section(span, start, end, order), return_counts=True)
                        earliest = np.array([span[0] - 1 if h < 0 else start[h] for h in held])
                        chosen[t] = held[np.lexsort((earliest, -times))[0]]
                tokens = np.bincount(chosen[chosen >= 0], minlength=len(start))
                crossing = np.bincount(chosen[(chosen >= 0) & (a != b)], minlength=len(start))
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                out = [owner, number, start - first_char[owner], end - first_char[owner], tokens, crossing]
                if (chosen < 0).any():
                    text_of = np.searchsorted(np.cumsum(lens), stops[chosen < 0] - 1, "right")
                    text_of, count = np.unique(text_of, return_counts=True)
                    over = np.bincount(np.searchsorted(np.cumsum(lens), stops[(chosen < 0) & (a != b)] - 1, "right"), minlength=len(lens))
                    none = np.full(len(text_of), -1)
                    out = [np.concatenate(x) for x in zip(out, [text_of, none, none, none, count, over[text_of]])]
                columns = [part.column("id").take(pa.array(out[0])), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)
