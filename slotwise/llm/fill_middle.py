"""Fill-in-middle transformation by one repeated-capture match per text.

A text is a row of units: runs of letters, or single other characters. One ``fullmatch`` of (unit)*
by the regex library keeps every repetition of its group, so ``match.ends(1)`` has the number of
units as its length and the code-point offset of any cut as one of its entries. The stretch between
two cuts, drawn from the SHA-256 of the document's id, moves behind the text, with marks between
the parts: prefix, suffix, middle (psm) or suffix, prefix, middle (spm). Some documents stay plain,
and so does a text that holds a mark of its own, so that each output gives back its text exactly.

Defined cases: a null text is empty; an empty text stays plain with no units; a null doc_id draws as
the empty string, ids that aren't integers as their text; repeated rows get the same form and cuts;
an empty table gives an empty result. Other columns pass through, whatever their names. Texts of any
length are matched whole; the group is possessive, so nothing is kept for backtracking.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from slotwise.llm.common import packed, unpacked

UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
# Fixed by the contract: the marks, the share of plain documents and that of suffix-first ones.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
SLICE = 256  # texts in Python at a time

FIM = "fim struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"
FIM_TYPE = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def draws(key: str) -> list[int]:
    """Four numbers below 2 ** 32 for a document's id."""
    digest = hashlib.sha256(f"1:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def cut(key: str, text: str) -> dict:
    """Number of units, form, lengths of prefix and middle, and the output of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(key)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    first, second = f"{PREFIX}{text[:a]}", f"{SUFFIX}{text[b:]}"
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    parts = second + first if form == "spm" else first + second
    return {"n": n, "form": form, "prefix_chars": a, "middle_chars": b - a, "output": f"{parts}{MIDDLE}{text[a:b]}"}


def transformed(docs: DataFrame) -> DataFrame:
    """(row, fim): the whole row of a document, and n, form, prefix_chars, middle_chars and output."""
    table = packed(docs, "row", key=F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text=F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                made = [cut(k.as_py(), t.as_py()) for k, t in zip(batch["key"], batch["text"], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["row"], pa.array(made, FIM_TYPE)], names=["row", "fim"])

    return table.mapInArrow(run, f"row {table.schema['row'].dataType.simpleString()}, {FIM}")


def rebuilt(output: Column, form: Column) -> Column:
    """The original text, from an output and its form alone: marks stand where they are first found."""
    body = F.substring(output, F.lit(1 + len(PREFIX)), F.length(output))
    other = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    first, last = F.position(other, body), F.position(F.lit(MIDDLE), body)
    head = F.substring(body, F.lit(1), first - 1)
    second = F.substring(body, first + len(SUFFIX), last - first - len(SUFFIX))
    middle = F.substring(body, last + len(MIDDLE), F.length(body))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, second)).otherwise(F.concat(second, middle, head))


def apply(docs: DataFrame) -> DataFrame:
    """The documents with their outputs as text; other columns as they are."""
    out = transformed(docs)
    return out.select(*(F.col("fim.output").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """Per document: units, form, lengths, and digests of the output and of the text rebuilt from it."""
    out = unpacked(transformed(docs.select("doc_id", "text")), "row", docs.select("doc_id"), "fim.*")
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(rebuilt(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


SQL = """
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units,
    sha256('1:' || coalesce(doc_id::varchar, '')) as h
  from documents
), drawn as (
  select *, len(units)::bigint as n, ('0x' || h[1:8])::ubigint % (len(units) + 1) as c1, ('0x' || h[9:16])::ubigint % (len(units) + 1) as c2,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::ubigint % 100 >= 90 then 'plain'
      when ('0x' || h[25:32])::ubigint % 100 < 20 then 'spm' else 'psm' end as form
  from cut
), parts as (
  select *, array_to_string(units[1 : least(c1, c2)], '') as p, array_to_string(units[least(c1, c2) + 1 : greatest(c1, c2)], '') as m,
    array_to_string(units[greatest(c1, c2) + 1 :], '') as s
  from drawn
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
