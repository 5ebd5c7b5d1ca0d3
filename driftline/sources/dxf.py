"""Drawing exchange files (ASCII group codes) as entity rows, and back.

One file is one row of work: the format is a sequence of (code, value) line pairs that only
reads from its start, so files spread over tasks and a file does not. Broken files give a
row with a status instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw entity names and the kind each is read as (fixed values).
KINDS = {
    "LINE": "line", "LWPOLYLINE": "polyline", "POLYLINE": "polyline", "CIRCLE": "circle", "ARC": "arc", "ELLIPSE": "ellipse", "SPLINE": "spline", "TEXT": "text", "MTEXT": "mtext", "INSERT": "block_reference",
    "HATCH": "hatch", "DIMENSION": "dimension", "ATTRIB": "attrib", "ATTDEF": "attdef",
}
SCHEMA = "path string, status string, section string, block string, ordinal long, raw_type string, kind string, layer string, x double, y double, x2 double, y2 double, radius double, angle double, angle2 double, text string, name string, color string, linetype string, closed boolean, vertices array<struct<x:double,y:double,bulge:double>>, sx double, sy double, nx double, ny double, nz double, measurement double, layout string, space string, owner long"
#: Group codes of fields that are read as they are (fixed values).
_FIELDS = {
    "8": "layer", "10": "x", "20": "y", "11": "x2", "21": "y2", "40": "radius", "50": "angle", "51": "angle2", "1": "text", "2": "name", "62": "color", "6": "linetype", "210": "nx", "220": "ny", "230": "nz", "410": "layout",
}
#: Fields that a code means for some raw types only (fixed values).
_OWN_FIELDS = {"INSERT": {"41": "sx", "42": "sy"}, "DIMENSION": {"42": "measurement"}}
_NUMBERS = {"x", "y", "x2", "y2", "radius", "angle", "angle2", "sx", "sy", "nx", "ny", "nz", "measurement"}


_COLUMNS = [f.split()[0] for f in SCHEMA.replace("struct<x:double,y:double,bulge:double>", "s").split(", ")]


def pairs(text: str) -> Iterator[tuple[str, str]]:
    """(group code, value) of each pair of lines; an odd last line does not count."""
    lines = text.splitlines()
    for i in range(0, len(lines) - 1, 2):
        yield lines[i].strip(), lines[i + 1].strip()


def records(text: str, skip: frozenset[str] = frozenset({"OBJECTS"})) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """(section, type, fields) of each record, without the sections to skip."""
    section, held = "", None
    for code, value in pairs(text):
        if code == "0":
            if held is not None and section not in skip:
                yield section, held[0], held[1]
            held = (value, []) if value not in ("SECTION", "ENDSEC", "EOF") else None
            if value == "ENDSEC":
                section = ""
            if value == "SECTION":
                section = "?"
        elif section == "?" and code == "2":
            section = value
        elif held is not None:
            held[1].append((code, value))
    if held is not None and section not in skip:
        yield section, held[0], held[1]


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def rows_of(path: str, text: str) -> list[dict]:
    """Entity rows of one file, and a row for each entry of its layer table and for its unit.

    Vertices that follow a polyline belong to it, attributes that follow an insert have
    its ordinal as their ``owner``. ``space`` is model, paper or block.
    """
    out, block, open_line, insert = [], None, None, None
    for section, kind, fields in records(text):
        if section == "TABLES" and kind == "LAYER":
            named = {name: next((v for c, v in fields if c == code), None) for code, name in (("2", "name"), ("62", "color"), ("6", "linetype"))}
            out.append(_row(path, "layer", section, None, len(out), kind) | named | {"layer": named["name"]})
            continue
        if kind == "BLOCK":
            block = next((v for c, v in fields if c == "2"), "")
            continue
        if kind == "ENDBLK":
            block = None
            continue
        if kind in ("VERTEX", "SEQEND"):
            if kind == "VERTEX" and open_line is not None:
                at = {c: _number(v) for c, v in fields if c in ("10", "20", "42")}
                open_line["vertices"].append((at.get("10"), at.get("20"), at.get("42") or 0.0))
            continue
        open_line = None
        if section not in ("ENTITIES", "BLOCKS") or kind not in KINDS:
            if section in ("ENTITIES", "BLOCKS"):
                out.append(_row(path, "unsupported", section, block, len(out), kind))
            continue
        row = _row(path, "ok", section, block, len(out), kind)
        row["space"] = "block" if block is not None else "paper" if ("67", "1") in fields else "model"
        own = _OWN_FIELDS.get(kind, {})
        for code, value in fields:
            name = own.get(code) or _FIELDS.get(code)
            if name and row[name] is None:
                row[name] = _number(value) if name in _NUMBERS else value
            if code == "70" and kind in ("LWPOLYLINE", "POLYLINE"):
                row["closed"] = bool(int(_number(value) or 0) & 1)
        if kind in ("LWPOLYLINE", "SPLINE"):
            row["vertices"] = _corners(fields)
        if kind == "ATTRIB":
            row["owner"] = insert
        elif kind == "INSERT":
            insert = len(out)
        if kind == "POLYLINE":
            row["vertices"], open_line = [], row
        out.append(row)
    return out or [_row(path, "empty", None, None, 0, None)]


def _corners(fields: list[tuple[str, str]]) -> list[tuple]:
    """Vertices of one record: each starts at its first coordinate; what comes behind belongs to it."""
    out: list[dict] = []
    for code, value in fields:
        if code == "10":
            out.append({"10": _number(value)})
        elif code in ("20", "42") and out:
            out[-1][code] = _number(value)
    return [(v["10"], v.get("20"), v.get("42") or 0.0) for v in out]


def _row(path, status, section, block, ordinal, raw) -> dict:
    row = dict.fromkeys(_COLUMNS)
    return row | {"path": path, "status": status, "section": section, "block": block, "ordinal": ordinal, "raw_type": raw, "kind": KINDS.get(raw or "")}


def read(spark: SparkSession, folder: str, pattern: str = "*.dxf", recursive: bool = True) -> DataFrame:
    """Entities of every matching file below a folder; ``status`` is ok, unsupported, empty or failed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = rows_of(path, content.decode("utf-8", errors="replace"))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows = [_row(path, f"failed: {type(e).__name__}", None, None, 0, None)]
                for row in rows:
                    row["vertices"] = None if row["vertices"] is None else [{"x": x, "y": y, "bulge": b} for x, y, b in row["vertices"]]
                yield pd.DataFrame(rows, columns=_COLUMNS).astype({"owner": "Int64"})

    return files.mapInPandas(parse, SCHEMA)


def layers(entities: DataFrame) -> DataFrame:
    """The layers of each file that an entity or the layer table names."""
    return entities.filter("status IN ('ok', 'layer')").select("path", "layer").distinct()


def layer_table(entities: DataFrame) -> DataFrame:
    """``path layer color linetype`` of the layer tables."""
    return entities.filter("status = 'layer'").select("path", "layer", "color", "linetype")


def of_layout(entities: DataFrame, layout: str = "Model") -> DataFrame:
    """The entities of one layout; what stands in paper space without a layout's name is in ``Layout1``."""
    own = F.coalesce("layout", F.when(F.col("space") == "paper", "Layout1").otherwise("Model"))
    return entities.filter((F.col("status") == "ok") & (F.col("space") != "block") & (F.lower(own) == layout.lower()))


def written(records: DataFrame, folder: str, by: str = "drawing") -> None:
    """Drawings as files, a folder each: ``records`` has ``by``, ``section``, ``ordinal``, ``raw_type`` and ``fields`` (structs of code, value).

    A drawing's records are put together in one row, as a file is one row when read.
    Sections come as tables, blocks, entities.
    """
    body = F.array_join(F.transform("fields", lambda f: F.concat_ws("\n", f["code"], f["value"])), "\n")
    one = F.concat_ws("\n", F.lit("0"), "raw_type", F.when(F.size("fields") > 0, body))
    parts = records.groupBy(by, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", one.alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    head = F.concat_ws("\n", F.lit("0"), F.lit("SECTION"), F.lit("2"), "section", "text", F.lit("0"), F.lit("ENDSEC"))
    place = F.array_position(F.array(*map(F.lit, ("HEADER", "TABLES", "BLOCKS", "ENTITIES"))), F.col("section"))
    files = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), head.alias("text")))).alias("parts"))
    files = files.select(by, F.concat_ws("\n", F.array_join(F.transform("parts", lambda x: x["text"]), "\n"), F.lit("0"), F.lit("EOF")).alias("value"))
    files.write.mode("overwrite").partitionBy(by).text(folder)


def fields(**values) -> F.Column:
    """Structs of group code and value from columns by ``g<code>`` (several of one code by a list); null values are left out."""
    each = [(name[1:], v) for name, value in values.items() for v in (value if isinstance(value, list) else [value])]
    return F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(code).alias("code"), v.cast("string").alias("value"))) for code, v in each]))


def unsupported(entities: DataFrame) -> DataFrame:
    """Raw types that are not read, with their counts."""
    return entities.filter("status = 'unsupported'").groupBy("path", "raw_type").agg(F.count("*").alias("n"))


def version(header: bytes) -> str:
    """The format's version mark of a binary drawing (its first six bytes), or ``unknown``."""
    mark = header[:6].decode("ascii", errors="replace")
    return mark if mark.startswith("AC10") else "unknown"


def write_text(entities: list[dict]) -> str:
    """An ASCII file of lines, circles and texts; what ``rows_of`` reads back."""
    out = ["0", "SECTION", "2", "ENTITIES"]
    for e in entities:
        out += ["0", e["raw_type"]]
        for code, name in _FIELDS.items():
            if e.get(name) is not None:
                out += [code, str(e[name])]
    return "\n".join([*out, "0", "ENDSEC", "0", "EOF", ""])
