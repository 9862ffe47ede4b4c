"""Raw one-record texts (csv, tsv, FASTA) to typed rows, failures set aside with their reason."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The five fields, the symbols a residue may be, and what is trimmed around fields.
FIELDS = ("family_id", "ord", "seq_id", "descr", "residues")
SYMBOLS = frozenset("ARNDCQEGHILKMFPSTWYVBJZX-_*")
TRIMMED = " \t\r\n"

_END = re.compile(r"(?:\r?\n)+\Z")
_FIELD = re.compile(r'"(?:[^"]|"")*+"|[^",]*+')
_DIGITS = re.compile(r"[0-9]+\Z")

SCHEMA = "raw_id long, family_id string, ord long, ord_text string, seq_id string, descr string, residues string, reason string"


class Rejected(ValueError):
    """A record that fails; the text is the reason."""


def assemble(text: str) -> str:
    """Walk a csv record field by field, aware of quotes, and give it with every field quoted, so that line ends and commas
    within fields cannot end them. Raises csv.Error on bad quoting."""
    fields, at = [], 0
    while True:
        m = _FIELD.match(text, at)
        end = m.end()
        if end < len(text) and text[end] != ",":
            raise csv.Error("a quote where none may stand")
        fields.append(m[0] if text.startswith('"', at) else f'"{m[0]}"')
        if end == len(text):
            return ",".join(fields)
        at = end + 1


def csv_fields(text: str) -> list[str]:
    """The fields of one csv record, by Python's strict reader. Line ends inside a record are ordinary characters."""
    try:
        csv.field_size_limit(sys.maxsize)  # texts are parsed whole
        return next(csv.reader([assemble(text)], strict=True), [])
    except csv.Error as e:
        raise Rejected("quoting") from e


def assemble_lines(lines: Iterable[str]) -> Iterator[str]:
    """Whole csv records out of the lines of a file: a record goes on as long as a quoted field is open.

    A quote opens a field only where one may begin. A record whose field never ends holds the rest of the lines.
    """
    held: list[str] = []
    inside = False
    for line in lines:
        held.append(line)
        begins, i = not inside, 0
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        inside = False
                begins = False
            elif c == '"' and begins:
                inside = True
            else:
                begins = c == ","
            i += 1
        if not inside:
            yield "".join(held)
            held = []
    if held:
        yield "".join(held)


def records_of_files(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(file_name, place, layout, raw_text) of the records in files of one layout, in the form load_records takes.

    A file is read whole by one task, as only its beginning tells which quotes are open: give many files, not a large one.
    place counts the records of a file from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = text.splitlines(keepends=True) if layout != "csv" else re.findall(r"[^\n]*\n|[^\n]+", text)
                if layout == "fasta":
                    found = re.findall(r"(?:>|[^>\n])[^\n]*(?:\n(?!>)[^\n]*)*", text)
                else:
                    found = list(assemble_lines(lines)) if layout == "csv" else [x for x in lines if x.strip("\r\n")]
                n = len(found)
                yield pa.RecordBatch.from_pydict(
                    {"file_name": pa.array([name] * n, pa.string()), "place": pa.array(range(n), pa.int64()), "layout": pa.array([layout] * n, pa.string()), "raw_text": pa.array(found, pa.string())}
                )

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), "value")
    return texts.mapInArrow(run, "file_name string, place long, layout string, raw_text string")


def fasta_fields(text: str) -> list[str]:
    if not text.startswith(">"):
        raise Rejected("columns")
    head, *lines = re.split(r"\r?\n", text)
    if any(x.startswith(">") for x in lines):
        raise Rejected("columns")
    name = re.match(r">([^ \t]*)[ \t]?(.*)\Z", head, re.DOTALL)
    return ["", "", name[1], name[2], "".join(x.strip(TRIMMED) for x in lines)]


def typed(layout: str, fields: list[str]) -> dict:
    """The typed record, or Rejected with the first reason that applies."""
    family, order, name, descr, residues = fields
    name, order, residues = name.strip(TRIMMED), order.strip(TRIMMED), residues.strip(TRIMMED)
    if not name or any(c.isspace() for c in name):
        raise Rejected("bad_id")
    if layout != "fasta" and not _DIGITS.match(order):
        raise Rejected("bad_ord")
    if not SYMBOLS.issuperset(residues.upper()):
        raise Rejected("bad_residues")
    digits = order.lstrip("0") or "0"
    number = int(digits) if order and (len(digits) < 19 or len(digits) == 19 and digits < str(2**63)) else None
    return {
        "family_id": family if layout != "fasta" else None, "ord": number, "ord_text": order if layout != "fasta" else None,
        "seq_id": name, "descr": descr or None, "residues": residues,
    }


def parse(layout: str | None, raw_text: str | None) -> dict:
    """One raw record as a dict of the typed fields, or with the reason for its failure."""
    try:
        text = _END.sub("", raw_text or "")
        kind = (layout or "").strip().lower()
        if kind == "fasta":
            fields = fasta_fields(text)
        elif kind == "csv":
            fields = csv_fields(text)
        elif kind == "tsv":
            fields = text.split("\t")
        else:
            raise Rejected("layout")
        if len(fields) != len(FIELDS):
            raise Rejected("columns")
        return typed(kind, fields)
    except Rejected as e:
        return {"reason": str(e)}


def load_records(raw: DataFrame, raw_id: str = "raw_id", layout: str = "layout", raw_text: str = "raw_text") -> DataFrame:
    """Every raw record as one row: typed fields and reason null if it is valid, else only raw_id and reason.

    reason is the first of quoting, columns, bad_id, bad_ord, bad_residues; a layout other than csv, tsv and fasta (or
    null) gives ``layout``. A null raw_text counts as empty, which is ``columns``. ord is null when it does not fit 64
    bits; ord_text keeps its digits. Texts of any length are parsed whole. Each row stands for itself, so nothing is
    shuffled; equal rows give equal rows, an empty table an empty one, and other columns are ignored.
    """
    names = ["raw_id", *FIELDS[:2], "ord_text", *FIELDS[2:], "reason"]
    kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 5]
    out_schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse(k, t) for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [b.column(0).cast(pa.int64())]
            cols += [pa.array([r.get(n) for r in rows], t) for n, t in zip(names[1:], kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(cols, schema=out_schema)

    cols = [F.col(raw_id).cast("long").alias("i"), F.col(layout).cast("string").alias("l"), F.col(raw_text).cast("string").alias("t")]
    return raw.select(*cols).mapInArrow(run, SCHEMA)


def split_valid(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejects with reason) of load_records."""
    return loaded.where("reason is null").drop("reason"), loaded.where("reason is not null").select("raw_id", "reason")
