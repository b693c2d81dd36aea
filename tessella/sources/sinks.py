"""Writing tables as JSON, N-Triples, text reports, sheets and workbooks."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object per row, by Spark's writer; letters are not escaped."""
    df.write.mode("overwrite").json(path)


def ntriples_line(s: Column, p: Column, o: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    """A triple as a line of N-Triples (which is Turtle, too)."""
    text = o
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")

    def node(c: Column) -> Column:
        return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    return F.concat(node(s), F.lit(" <"), p, F.lit("> "), F.when(kind == "literal", F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(node(o)), F.lit(" ."))


def ntriples(triples: DataFrame) -> DataFrame:
    return triples.select(ntriples_line(*[F.col(c) for c in ("s", "p", "o", "o_kind", "o_datatype", "o_lang")]).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, folders: bool = True) -> None:
    """Report lines as text files in a folder per document, their names in the order of the lines, or with ``folders`` off in files that each hold a range of
    documents (for many documents, as a folder for each would burden the file system). Lines are ordered by doc_id and what there is of part, k, n and place; rows are
    ranged and sorted by these, so a long document is spread over several files."""
    order = [c for c in ("doc_id", "part", "k", "n", "place") if c in lines.columns]
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    if folders:
        rows.select("doc_id", "line").write.mode("overwrite").partitionBy("doc_id").text(path)
    else:
        rows.select("line").write.mode("overwrite").text(path)


def preview(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first paragraphs of a document, long ones shortened, to look at."""
    t = F.col("text")
    return rows.orderBy("doc_id", "k").limit(n).select("doc_id", "k", "lang", F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 80), F.lit("…"))).otherwise(t).alias("text"))


def write_sheet(df: DataFrame, path: str) -> None:
    """A table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_workbook(sheets: dict[str, DataFrame], path: str, most_rows: int = 100_000) -> None:
    """A workbook with bold, frozen, filtered headers. A workbook is one file for people, so a sheet of more than
    ``most_rows`` rows is refused: write it as CSV."""
    names, parts = list(sheets), []
    for df in sheets.values():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"more than {most_rows} rows: use write_sheet")
        parts.append((df.columns, rows))

    def ref(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(r: int, c: int, v, bold: bool = False) -> str:
        where, style = f"{ref(c)}{r}", ' s="1"' if bold else ""
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{where}" t="b"{style}><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f'<c r="{where}"{style}><v>{v}</v></c>'
        return f'<c r="{where}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def sheet(columns: list[str], rows: list) -> str:
        lines = [f'<row r="1">{"".join(cell(1, i, c, True) for i, c in enumerate(columns))}</row>']
        lines += [f'<row r="{n}">{"".join(cell(n, i, v) for i, v in enumerate(row))}</row>' for n, row in enumerate(rows, 2)]
        widths = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{min(60, max(10, len(c) + 2))}" customWidth="1"/>' for i, c in enumerate(columns))
        last = f"{ref(len(columns) - 1)}{len(rows) + 1}"
        return (
            f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            f'<cols>{widths}</cols><sheetData>{"".join(lines)}</sheetData><autoFilter ref="A1:{last}"/></worksheet>'
        )

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{SHEET}.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{SHEET}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{SHEET}.styles+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{RELS}"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i + 1}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{RELS}">{links}<Relationship Id="st" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, (columns, rows) in enumerate(parts):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", sheet(columns, rows))


# Names of the workbook format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml"
