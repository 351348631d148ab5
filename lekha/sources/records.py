"""Documents and section lists in block form (a part of YAML), and sinks for tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lekha.operators.model import DOC

_ENTRY = re.compile(r"^(\s*)(-\s+)?(?:([A-Za-z_][\w-]*):)?\s*(.*?)\s*$")
_LEGACY = ("dhvani", "shlok", "jabani")
_TEXTS = {"sthayi", "pre_shlok", "pre_sthayi", "post_shlok", *_LEGACY}


def _scalar(value: str):
    quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
    value = value[1:-1] if quoted else value
    return {"true": True, "false": False}.get(value, value)


class Block:
    """Lines of a document, read as entries: an indent, a list mark, a key, a value, and for | the text below."""

    def __init__(self, text: str):
        self.lines = text.removeprefix("﻿").replace("\r\n", "\n").split("\n")

    def entries(self, at: int, indent: int, end: int) -> Iterator[tuple[int, int, bool, str | None, object, int]]:
        """(line, indent, listed, key, value, next line) of the entries from a line on that are not less indented; a literal's lines belong to its entry."""
        while at < end:
            raw = self.lines[at]
            if not raw.strip() or (not indent and raw.lstrip().startswith("#")):
                at += 1
                continue
            m = _ENTRY.match(raw)
            own = len(m[1])
            if own < indent:
                return
            stop, value = at + 1, m[4]
            if value == "|":
                plain = m[3] == "lyrics" and not own  # lasts up to the next entry, however its lines are indented
                base = own + (4 if m[2] and m[3] not in (None, "commentary") else 2)
                while stop < end and (not re.match(r"[A-Za-z_][\w-]*:\s", self.lines[stop]) if plain else not self.lines[stop].strip() or self._indent(stop) >= base):
                    stop += 1
                below = self.lines[at + 1 : stop]
                value = "\n".join(re.sub(r"^\s{0,2}", "", x) if plain else x[base:] if x.strip() else "" for x in below).rstrip("\n")
                yield at, own, bool(m[2]), m[3], (value,), stop
            else:
                yield at, own, bool(m[2]), m[3], value, stop
            at = stop

    def _indent(self, at: int) -> int:
        return len(self.lines[at]) - len(self.lines[at].lstrip())


def _paragraphs(block: Block, at: int, indent: int, end: int) -> tuple[list[dict], int]:
    out = []
    for line, own, listed, key, value, stop in block.entries(at, indent, end):
        if not listed or key not in (None, "commentary") or not isinstance(value, tuple):
            return out, line
        out.append({"kind": "commentary" if key else "antara", "text": value[0]})
        at = stop
    return out, at


def _lyrics(block: Block, at: int, end: int) -> dict:
    """The lyrics' fields up to the first entry that is not understood."""
    found: dict = {}
    later: list[str] = []
    while at < end:
        entry = next(block.entries(at, 2, end), None)
        if entry is None:
            break
        line, own, listed, key, value, stop = entry
        if own != 2 or listed:
            break
        if key == "paragraphs" and value == "":
            found["paragraphs"], stop = _paragraphs(block, stop, 2, end)
        elif key == "parts" and value == "":
            found["parts"], stop = _parts(block, stop, end)
        elif key in _TEXTS and isinstance(value, tuple):
            if key in _LEGACY:
                later.append(value[0])
            else:
                found["pre_shlok" if key == "pre_sthayi" else key] = value[0]
        elif key == "sthayi_connect" and value in ("true", "false"):
            found[key] = value == "true"
        elif key == "sthayi_connect_text":
            found[key] = " ".join(value[0].split("\n")).strip() if isinstance(value, tuple) else value
        else:
            break
        at = stop
    found["later"] = [found.pop("post_shlok", ""), *later]
    return found


def _parts(block: Block, at: int, end: int) -> tuple[list[dict], int]:
    parts: list[dict] = []
    while at < end:
        entry = next(block.entries(at, 4, end), None)
        if entry is None:
            break
        line, own, listed, key, value, stop = entry
        if own == 4 and listed and key == "sthayi" and isinstance(value, tuple):
            parts.append({"sthayi": value[0], "paragraphs": []})
        elif parts and own == 6 and key == "paragraphs" and value == "":
            parts[-1]["paragraphs"], stop = _paragraphs(block, stop, 8, end)
        else:
            return parts, line
        at = stop
    return parts, at


def parse_document(text: str | None) -> dict:
    """One document; keys that it does not have are absent. Old names of the closing verses become post_shlok, joined by blank lines."""
    block, doc, later = Block(text or ""), {}, []
    at, end = 0, len(block.lines)
    while at < end:
        entry = next(block.entries(at, 0, end), None)
        if entry is None:
            break
        line, own, _, key, value, stop = entry
        if key == "lyrics" and value == "" and not own:
            doc["lyrics"] = _lyrics(block, stop, end)
            stop = next((i for i in range(stop, end) if re.match(r"[A-Za-z_#]", block.lines[i])), end)
        elif key == "also_in" and value == "":
            items = []
            for _, i, listed, k, v, after in block.entries(stop, 2, end):
                if not listed or i != 2:
                    break
                items.append(v if k is None else f"{k}: {v}")
                stop = after
            doc["also_in"] = items
        elif key in ("post_shlok", *_LEGACY):
            later.append(value[0] if isinstance(value, tuple) else value)
        elif key and not own:
            doc[key] = value[0] if isinstance(value, tuple) else _scalar(value)
        at = stop
    body = doc.get("lyrics")
    later += body.pop("later", []) if isinstance(body, dict) else []
    closing = "\n\n".join(x.strip() for x in later if x and x.strip())
    if (closing or doc.get("pre_shlok")) and not isinstance(body, dict):
        body = {}
    if isinstance(body, dict):
        if closing:
            body["post_shlok"] = closing
        if doc.get("pre_shlok") and not body.get("pre_shlok"):
            body["pre_shlok"] = doc["pre_shlok"]
    doc["lyrics"] = {"text": body} if isinstance(body, str) else body
    return doc


def _filled(value: dict | None, kind: StructType):
    """A dict with all fields of a struct, nested ones too."""
    if value is None:
        return None
    out = {}
    for f in kind.fields:
        v = value.get(f.name)
        of = getattr(f.dataType, "elementType", None)
        out[f.name] = _filled(v, f.dataType) if isinstance(f.dataType, StructType) else [_filled(x, of) for x in v] if isinstance(of, StructType) and v is not None else v
    return out


def parse_docs(raw: DataFrame) -> DataFrame:
    """DOC rows of raw (path, text); a text that is null or holds nothing gives a row of nulls."""
    schema = _parse_datatype_string(DOC)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc = parse_document(text)
                also = doc.get("also_in")
                text_of = lambda k, d=doc: None if d.get(k) in (None, "") else str(d[k])
                rows.append(_filled({
                    "path": path, "title": text_of("title"), "tarz": text_of("tarz"), "group_name": text_of("group"), "self_authored": doc["swarachit"] if isinstance(doc.get("swarachit"), bool) else None,
                    "also_in": [also] if isinstance(also, str) and also else also if isinstance(also, list) else None, "lyrics": doc["lyrics"]}, schema))
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return raw.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(run, schema)


def read_sections(spark: SparkSession, text: str) -> DataFrame:
    """(section_pos, slug, folder, title, banner, sort, grouped, excluded, count_unit, connect) of a section list's text, in its order."""
    rows: list[dict] = []
    for line in text.removeprefix("﻿").splitlines():
        m = _ENTRY.match(line)
        if line.lstrip().startswith("#") or not m[3]:
            continue
        if m[2] and m[3] == "slug":
            rows.append({"slug": m[4]})
        elif m[1] and rows:
            rows[-1][m[3]] = _scalar(m[4])
    names = {"folder": "folder", "title": "title", "banner": "banner", "sort": "bhajan_order", "grouped": "grouped", "excluded": "exclude_from_bhajan_count", "count_unit": "count_unit", "connect": "sthayi_connect"}
    values = [(i, r["slug"], *(r.get(k) for k in names.values())) for i, r in enumerate(rows)]
    kinds = [f"{n} {'boolean' if n in ('grouped', 'excluded', 'connect') else 'string'}" for n in names]
    return spark.createDataFrame(values, "section_pos int, slug string, " + ", ".join(kinds))


def write_search_index(items: DataFrame, path: str) -> None:
    """JSON lines, a folder a section."""
    items.write.partitionBy("section").json(path)


def write_issues(issues: DataFrame, path: str) -> None:
    issues.write.parquet(path)


def write_changed(before: DataFrame, after: DataFrame, path: str) -> None:
    """Write the rows of after (doc_id, section, text) whose text differs from before's, a folder a section; new rows too."""
    old = before.select("doc_id", F.col("text").alias("__before"))
    after.join(old, "doc_id", "left").where(~F.col("text").eqNullSafe(F.col("__before"))).drop("__before").write.mode("overwrite").partitionBy("section").parquet(path)


def write_decisions(decisions: DataFrame, path: str) -> None:
    decisions.write.json(path)


def read_decisions(spark: SparkSession, path: str, defaults: DataFrame) -> DataFrame:
    """defaults (id, action, canonical, replace, forms) with the saved action and canonical form where there are any; replace is then all other forms."""
    saved = spark.read.schema("id string, action string, canonical string").json(path).select("id", F.col("action").alias("a"), F.col("canonical").alias("c"))
    rows = defaults.join(saved, "id", "left").select("id", F.coalesce("a", "action").alias("action"), F.coalesce("c", "canonical").alias("canonical"), "forms")
    return rows.withColumn("replace", F.filter("forms", lambda x: x != F.col("canonical")))
