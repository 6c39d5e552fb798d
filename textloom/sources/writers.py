"""Writers: distributed Parquet and CSV, and small reports made on the driver from collected results."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import xml.etree.ElementTree as ET
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.sources import files, textfiles

#: Rows that a driver-side report may have.
REPORT_ROWS = 100_000


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of CSV parts with headers; the committer makes it whole or not there at all."""
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def write_csv_chunks(df: DataFrame, path: str, rows: int = 50_000) -> None:
    """CSV parts of at most ``rows`` rows each, written as they come."""
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows).csv(path)


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """A file <name>.txt for each text, a null as an empty one; tasks write those of their rows, in folders of some thousands."""
    rows = df.select(F.col(name).cast("string").alias("filename"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "filename").sortWithinPartitions("filename").write.format(textfiles.registered(df.sparkSession)).mode("overwrite").save(path)


def with_deviations(df: DataFrame, metrics: list[str]) -> DataFrame:
    """df with each metric's ``<metric>_standard_deviation``, where it has one, right after the metric; null where the metric
    is."""
    out = []
    for c in df.columns:
        of = c.removesuffix("_standard_deviation")
        if of != c and of in metrics:
            continue
        out.append(F.col(c))
        if c in metrics and f"{c}_standard_deviation" in df.columns:
            out.append(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(f"{c}_standard_deviation")).alias(f"{c}_standard_deviation"))
    return df.select(*out)


def write_by_output(contributions: DataFrame, path: str) -> None:
    """A table of features for each output of a model (band or level), the largest contribution first."""
    rows = contributions.select("output", F.col("feature").alias("feature_name"), F.col("mean_absolute").alias("contribution"))
    rows.repartition("output").sortWithinPartitions("output", F.col("contribution").desc(), "feature_name").write.mode("overwrite").partitionBy("output").parquet(path)


def small(df: DataFrame) -> list[dict]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    return [r.asDict() for r in rows]


def write_report_csv(df: DataFrame, path: str) -> None:
    """One file with a byte-order mark, put in place at once."""
    out = io.StringIO()
    w = csv.DictWriter(out, df.columns, lineterminator="\n")
    w.writeheader()
    w.writerows(small(df))
    files.put(path, out.getvalue().encode("utf-8-sig"))


def write_json(value: object, path: str) -> None:
    files.put(path, (json.dumps(value, indent=1, ensure_ascii=False, sort_keys=True) + "\n").encode())


def write_counts_xml(counts: DataFrame, path: str) -> None:
    """Bands with their counts and levels below them, from (cefr_level, level, n)."""
    root, bands = ET.Element("counts"), {}
    for r in sorted(small(counts), key=lambda r: (r["cefr_level"], r["level"])):
        band = bands.setdefault(r["cefr_level"], ET.SubElement(root, "cefr", name=r["cefr_level"], count="0") if r["cefr_level"] not in bands else None)
        band.set("count", str(int(band.get("count")) + r["n"]))
        ET.SubElement(band, "level", name=str(r["level"]), count=str(r["n"]))
    ET.indent(root)
    files.put(path, ET.tostring(root, encoding="utf-8", xml_declaration=True))


def _cell(v: object, digits: int) -> str:
    return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def markdown(df: DataFrame, digits: int = 3) -> str:
    rows = [[_cell(r[c], digits) for c in df.columns] for r in small(df)]
    return "\n".join("| " + " | ".join(x) + " |" for x in [df.columns, ["---"] * len(df.columns), *rows]) + "\n"


def latex(df: DataFrame, digits: int = 3) -> str:
    safe = lambda s: "".join("\\" + c if c in "&%$#_{}" else c for c in s)
    rows = [" & ".join(safe(_cell(r[c], digits)) for c in df.columns) + r" \\" for r in small(df)]
    head = " & ".join(map(safe, df.columns)) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}"]) + "\n"


def write_xlsx(df: DataFrame, path: str) -> str:
    """A workbook of the rows with a hidden sheet that has their digest; the digest."""
    rows = [df.columns, *[[r[c] for c in df.columns] for r in small(df)]]
    digest = digest_of(df)

    def sheet(table: list) -> str:
        cell = lambda v: "<c/>" if v is None else f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
        return '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in table) + "</sheetData></worksheet>"

    main, rel, pkg = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="table" sheetId="1" r:id="r1"/><sheet name="provenance" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/worksheet" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet(rows), "xl/worksheets/sheet2.xml": sheet([["sha256", digest]]),
    }
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    files.put(path, book.getvalue())
    return digest


def digest_of(df: DataFrame) -> str:
    """A digest of the rows in any order, from per-row hashes: the manifest's fingerprint of a table."""
    h = F.xxhash64(*map(S.quoted, df.columns))
    a, b, n = df.agg(F.sum(h.cast("decimal(38,0)")), F.bit_xor(h), F.count("*")).first()
    return hashlib.sha256(f"{a}:{b}:{n}:{','.join(df.columns)}".encode()).hexdigest()


def write_manifest(tables: dict[str, DataFrame], path: str) -> None:
    write_json({k: {"digest": digest_of(v), "columns": v.columns} for k, v in tables.items()}, path)


def verify_manifest(tables: dict[str, DataFrame], path: str) -> list[str]:
    """The names of the tables that are not as the manifest says."""
    known = json.loads(files.get(path))
    return [k for k, v in tables.items() if known.get(k) != {"digest": digest_of(v), "columns": v.columns}]
