"""Rows of XLSX sheets and paragraphs of DOCX files, by Spark's Python data source interface.

Small files share a partition, and the sheets of a large workbook have one each. The XML parts are read as streams of events
over inflated blocks, so what a task holds is a block, a row and a workbook's shared strings.
"""

from __future__ import annotations

import io
import re
import zipfile
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from posixpath import join, normpath
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

START, END, TEXT = range(3)

#: Built-in number formats that show a date or time, and the base style names that files write in lower case.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)
LOWER_STYLES = ("caption", "footer", "header")


def _store(path: str):
    """The file system of a path, as pyarrow knows it, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ---- reading ----


def _events(stream) -> Iterator[tuple]:
    """(START, name, attributes), (TEXT, text, None) and (END, name, None), names without their namespaces."""
    parser, out = expat.ParserCreate(namespace_separator=" "), []
    local = lambda name: name.rpartition(" ")[2]

    def doctype(*_):
        raise ValueError("a document type in a part")

    parser.buffer_text = True
    parser.StartDoctypeDeclHandler = doctype
    parser.StartElementHandler = lambda name, given: out.append((START, local(name), {local(k): v for k, v in given.items()}))
    parser.EndElementHandler = lambda name: out.append((END, local(name), None))
    parser.CharacterDataHandler = lambda text: out.append((TEXT, text, None))
    while block := stream.read(1 << 16):
        parser.Parse(block, False)
        yield from out
        out.clear()
    parser.Parse(b"", True)
    yield from out


def _part(book: zipfile.ZipFile, name: str) -> Iterator[tuple]:
    """The events of a part; none where the file doesn't have it."""
    if name in book.NameToInfo:
        with book.open(name) as stream:
            yield from _events(stream)


def _unescaped(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


class _Strings:
    """Shared strings, end to end in one buffer."""

    def __init__(self, events: Iterator[tuple]):
        self.held, self.ends = bytearray(), array("Q", [0])
        in_text = phonetic = False
        for kind, name, _ in events:
            if kind == TEXT:
                if in_text and not phonetic:
                    self.held += name.encode("utf-8", "surrogatepass")
            elif name == "t":
                in_text = kind == START
            elif name == "rPh":
                phonetic = kind == START
            elif name == "si" and kind == END:
                self.ends.append(len(self.held))

    def __getitem__(self, n: int) -> str:
        if not 0 <= n < len(self.ends) - 1:
            raise ValueError(f"no shared string {n}")
        return _unescaped(self.held[self.ends[n] : self.ends[n + 1]].decode("utf-8", "replace"))


def _date_styles(events: Iterator[tuple]) -> list[bool]:
    """Whether each cell style shows a date or time."""
    codes, styles, within = {}, [], False
    for kind, name, given in events:
        if name == "cellXfs":
            within = kind == START
        elif kind == START and name == "numFmt":
            plain = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", given.get("formatCode", "").lower())
            codes[given.get("numFmtId")] = plain != "general" and bool(re.search("[dmyhs]", plain))
        elif kind == START and name == "xf" and within:
            number = given.get("numFmtId", "0")
            styles.append(codes.get(number, number.isdigit() and int(number) in DATE_FORMATS))
    return styles


def _targets(book: zipfile.ZipFile, rels: str, base: str) -> dict[str, str]:
    return {g["Id"]: normpath(join("/" + base, g["Target"])).lstrip("/") for k, name, g in _part(book, rels) if k == START and name == "Relationship" and g.get("TargetMode") != "External"}


def _sheets(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(name, part) of each worksheet in order, and whether days count from 1904."""
    targets, sheets, late = _targets(book, "xl/_rels/workbook.xml.rels", "xl"), [], False
    if "xl/workbook.xml" not in book.NameToInfo:
        raise ValueError("no workbook in it")
    for kind, name, given in _part(book, "xl/workbook.xml"):
        if kind == START and name == "sheet" and "worksheets/" in targets.get(given.get("id"), ""):
            sheets.append((given["name"], targets[given["id"]]))
        elif kind == START and name == "workbookPr":
            late = given.get("date1904") in ("1", "true")
    return sheets, late


def _number(text: str, date: bool, late: bool) -> str:
    value = float(text)
    if date and 0 <= value < 2958466:
        at = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        at += timedelta(seconds=round(value * 86400))
        return at.strftime("%H:%M:%S") if value < 1 else f"{at:%Y-%m-%d %H:%M:%S}"
    return text if text.lstrip("-").isdigit() else str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _column(reference: str) -> int:
    n = 0
    for c in reference.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def _rows(events: Iterator[tuple], strings: _Strings, dates: list[bool], late: bool) -> Iterator[tuple[int, list]]:
    """(row number from 0, values) of the rows of a sheet that hold something."""
    row, cells, col, given, held, taken, phonetic = -1, [], -1, {}, [], False, False
    for kind, name, attributes in events:
        if kind == TEXT:
            if taken and not phonetic:
                held.append(name)
        elif name == "v" or name == "t":
            taken = kind == START
        elif name == "rPh":
            phonetic = kind == START
        elif name == "c" and kind == START:
            given, held = attributes, []
            col = _column(given["r"]) if "r" in given else col + 1
        elif name == "c":
            text, sort = "".join(held), given.get("t", "n")
            style = int(given.get("s", 0))
            value = None
            if sort == "s" and text:
                value = strings[int(text)]
            elif sort in ("str", "inlineStr", "d"):
                value = _unescaped(text)
            elif sort == "b":
                value = "True" if text == "1" else "False"
            elif sort == "n" and text:
                value = _number(text.strip(), style < len(dates) and dates[style], late)
            if value is not None:
                cells.extend([None] * (col + 1 - len(cells)))
                cells[col] = value
        elif name == "row" and kind == START:
            row, cells, col = int(attributes["r"]) - 1 if "r" in attributes else row + 1, [], -1
        elif name == "row" and cells:
            yield row, cells


def _workbook(book: zipfile.ZipFile, only: str | None) -> Iterator[tuple]:
    sheets, late = _sheets(book)
    strings, dates = _Strings(_part(book, "xl/sharedStrings.xml")), _date_styles(_part(book, "xl/styles.xml"))
    for name, part in sheets:
        if only is None or part == only:
            for row, cells in _rows(_part(book, part), strings, dates, late):
                yield name, row, cells


def _styles(events: Iterator[tuple]) -> dict[str | None, str]:
    """Names of paragraph styles by id, and of the default one by None, as people see them."""
    names, of, default = {}, None, False
    for kind, name, given in events:
        if kind == START and name == "style":
            of = given.get("styleId") if given.get("type", "paragraph") == "paragraph" else None
            default = given.get("default") in ("1", "true")
        elif kind == START and name == "name" and of is not None:
            said = given.get("val", "")
            names[of] = said[0].upper() + said[1:] if said.startswith("heading ") or said in LOWER_STYLES else said
            if default:
                names[None] = names[of]
    return names


def _paragraphs(book: zipfile.ZipFile, _: str | None = None) -> Iterator[tuple]:
    """(number from 0, style, text) of the paragraphs of the body; those in tables, text boxes and fallbacks aren't of it."""
    if "word/document.xml" not in book.NameToInfo:
        raise ValueError("no document in it")
    styles = _styles(_part(book, "word/styles.xml"))
    pos, inside, style, held, taken, within = 0, 0, None, [], False, False
    for kind, name, given in _part(book, "word/document.xml"):
        if kind == TEXT:
            if taken and within and not inside:
                held.append(name)
        elif name in ("tbl", "txbxContent", "Fallback"):
            inside += 1 if kind == START else -1
        elif inside:
            continue
        elif name == "p" and kind == START:
            style, held, within = None, [], True
        elif name == "p":
            yield pos, styles.get(style) or styles.get(None, "Normal"), "".join(held)
            pos, within = pos + 1, False
        elif name == "t":
            taken = kind == START
        elif kind == START and name == "pStyle":
            style = given.get("val")
        elif kind == START and within and name in ("tab", "br", "cr"):
            # A tab stop in a paragraph's settings has a position.
            held.append("" if "pos" in given else "\t" if name == "tab" else "\n")


@dataclass
class _Some(InputPartition):
    """Files of a partition, each with the one part of it to read, or None for all."""

    files: list[tuple[str, str | None]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, suffix: str, read: Callable, empty: tuple, parts: Callable | None = None):
        self.path, self.suffix, self.rows, self.empty, self.parts = options["path"], suffix, read, empty, parts
        self.most, self.fail = int(options.get("maxpartitionbytes", 32 << 20)), options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def partitions(self) -> list[_Some]:
        """Files packed to `maxPartitionBytes` in the order of their names; larger ones by part where they have several."""
        from pyarrow import fs

        store, path = _store(self.path)
        found = [store.get_file_info(path)]
        if found[0].type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(path, recursive=True))
        elif found[0].type == fs.FileType.NotFound:
            raise ValueError(f"{self.path} isn't there")
        found = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.suffix) and f.base_name[0] not in "~._")
        out, files, size = [], [], 0
        for file, n in found:
            if n > self.most and self.parts:
                try:
                    with store.open_input_file(file) as f, zipfile.ZipFile(f) as book:
                        out.extend(_Some([(file, part)]) for part in self.parts(book))
                    continue
                except (zipfile.BadZipFile, ValueError, KeyError, expat.ExpatError):
                    pass  # Reading says what is wrong with it.
            if files and size + n > self.most:
                out.append(_Some(files))
                files, size = [], 0
            files.append((file, None))
            size += n
        return [*out, _Some(files)] if files else out or [_Some([])]

    def read(self, partition: _Some) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for file, part in partition.files:
            try:
                with store.open_input_file(file) as f, zipfile.ZipFile(f) as book:
                    for row in self.rows(book, part):
                        yield (file, *row, None)
            except (zipfile.BadZipFile, ValueError, KeyError, expat.ExpatError, RuntimeError, NotImplementedError, EOFError) as e:
                if self.fail:
                    raise
                yield (file, *self.empty, f"{type(e).__name__}: {e}")


class XlsxSource(DataSource):
    """Rows of the sheets of .xlsx files, row numbers from 0. A file that can't be read whole gives what comes before its
    fault and a row with `error`; with mode FAILFAST the job fails. Empty cells and errors are null, dates are as in
    `2024-05-31 00:00:00`, and formulas have their last values."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "path string, sheet string, row int, cells array<string>, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, ".xlsx", _workbook, (None, None, None), lambda book: [part for _, part in _sheets(book)[0]])


class DocxSource(DataSource):
    """Paragraphs of the bodies of .docx files with the names of their styles; faults as in XlsxSource."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return "path string, pos int, style string, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, ".docx", _paragraphs, (None, None, None))


def register(spark: SparkSession) -> None:
    """Make `spark.read.format("xlsx")` and `"docx"` known to a session."""
    for source in (XlsxSource, DocxSource):
        spark.dataSource.register(source)


def sheet_cells(rows: DataFrame, header_rows: int = 1) -> DataFrame:
    """Rows of XLSX files as (doc_id, path, sheet, row, cells) for the chunkers of sheets, a sheet being a document and cells
    an array of (col, header, value). The last of the header rows names the columns: nameless ones are `Unnamed: n`, repeated
    names get `.1` and so on; without header rows the names are numbers. Rows are numbered from 0 below the header rows."""
    if header_rows < 0:
        raise ValueError("header_rows must be at least 0")
    good = rows.filter("error IS NULL")
    below = good.filter(F.col("row") >= header_rows).select("path", "sheet", (F.col("row") - header_rows).alias("row"), F.col("cells").alias("v"))
    if header_rows == 0:
        below = below.withColumn("h", F.array().cast("array<string>"))
        nameless = lambda k: k.cast("string")
    else:
        named = good.filter(F.col("row") == header_rows - 1).select("path", "sheet", F.col("cells").alias("h"))
        earlier = lambda x, k: F.size(F.filter(F.slice("h", 1, k), lambda y: y == x))
        named = named.withColumn("h", F.transform("h", lambda x, k: F.when(F.trim(x) != "", F.when(earlier(x, k) > 0, F.concat(x, F.lit("."), earlier(x, k))).otherwise(x))))
        below = below.join(named, ["path", "sheet"], "left")
        nameless = lambda k: F.concat(F.lit("Unnamed: "), k)
    cell = lambda x, k: F.struct(k.alias("col"), F.coalesce(F.get(F.col("h"), k), nameless(k)).alias("header"), x.alias("value"))
    return below.select(F.concat_ws("#", "path", "sheet").alias("doc_id"), "path", "sheet", "row", F.transform("v", cell).alias("cells"))


# ---- writing ----

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
PACKAGE, OFFICE = "http://schemas.openxmlformats.org/package/2006/", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET, WORD = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
KINDS = "application/vnd.openxmlformats-officedocument."


def _package(main: str, kind: str, parts: dict[str, tuple[str, str]]) -> bytes:
    """A file of a main part and others, which are (kind, content) by their names beside the main part."""
    folder = main.rpartition("/")[0]
    out = io.BytesIO()
    relations = lambda of: HEAD + f'<Relationships xmlns="{PACKAGE}relationships">' + "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{t}" Target="{at}"/>' for i, t, at in of) + "</Relationships>"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        put = lambda name, text: book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode(), zipfile.ZIP_DEFLATED)
        types = "".join(f'<Override PartName="/{folder}/{name}" ContentType="{KINDS}{kind}.{t}+xml"/>' for name, (t, _) in parts.items())
        put("[Content_Types].xml", HEAD + f'<Types xmlns="{PACKAGE}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>')
        put("_rels/.rels", relations([("rId1", "officeDocument", main)]))
        others = [n for n in parts if f"{folder}/{n}" != main]
        put(f"{folder}/_rels/{main.rpartition('/')[2]}.rels", relations([(f"rId{k}", parts[n][0], n) for k, n in enumerate(others, 1)]))
        for name, (_, text) in parts.items():
            put(f"{folder}/{name}", HEAD + text)
    return out.getvalue()


def xlsx_file(rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet; integers as text become numbers, other texts are shared strings, None is no cell."""
    strings: dict[str, int] = {}
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row):
            at, n = "", c + 1
            while n:
                n, rest = divmod(n - 1, 26)
                at = chr(65 + rest) + at
            if value is None:
                continue
            if re.fullmatch("0|-?[1-9][0-9]{0,14}", value):
                cells.append(f'<c r="{at}{r}"><v>{value}</v></c>')
            else:
                cells.append(f'<c r="{at}{r}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    shared = "".join(f'<si><t xml:space="preserve">{escape(_escaped(s))}</t></si>' for s in strings)
    return _package("xl/workbook.xml", "spreadsheetml", {
        "workbook.xml": ("sheet.main", f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>'),
        "worksheets/sheet1.xml": ("worksheet", f'<worksheet xmlns="{SHEET}"><sheetData>{"".join(lines)}</sheetData></worksheet>'),
        "sharedStrings.xml": ("sharedStrings", f'<sst xmlns="{SHEET}" uniqueCount="{len(strings)}">{shared}</sst>'),
    })


def _escaped(text: str) -> str:
    """What XML can't hold, and what reads like an escape, as `_xHHHH_`."""
    return re.sub("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)", lambda m: f"_x{ord(m[0]):04X}_", text)


def docx_file(paragraphs: list[tuple[str, str]]) -> bytes:
    """A document of (style name, text); characters that XML can't hold become spaces."""
    names = {style: f"s{k}" for k, style in enumerate(dict.fromkeys(s for s, _ in paragraphs))}
    clean = lambda text: escape(re.sub("[\x00-\x08\x0b-\x0d\x0e-\x1f￾￿]", " ", text)).replace("\n", "</w:t><w:br/><w:t xml:space=\"preserve\">").replace("\t", "</w:t><w:tab/><w:t xml:space=\"preserve\">")
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{names[s]}"/></w:pPr><w:r><w:t xml:space="preserve">{clean(t)}</w:t></w:r></w:p>' for s, t in paragraphs)
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val={quoteattr(s[0].lower() + s[1:] if s.startswith("Heading ") else s)}/></w:style>' for s, i in names.items())
    return _package("word/document.xml", "wordprocessingml", {"document.xml": ("document.main", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'), "styles.xml": ("styles", f'<w:styles xmlns:w="{WORD}">{styles}</w:styles>')})


def _write(rows: DataFrame, folder: str, suffix: str, order: str, make: Callable) -> None:
    """One file for each value of `file`, made of its rows in order by one task and moved into place whole, so that a task
    that is run again leaves the same files."""

    def put(pdf):
        import uuid

        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        name, made = pdf["file"].iloc[0], f"{at}/.{uuid.uuid4().hex}"
        with store.open_output_stream(made) as f:
            f.write(make(pdf.sort_values(order)))
        store.move(made, f"{at}/{name}{suffix}")
        return pdf[["file"]].head(1)

    rows.groupBy("file").applyInPandas(put, "file string").write.format("noop").mode("overwrite").save()


def write_xlsx(rows: DataFrame, folder: str) -> None:
    """(file, row, cells array of strings) as folder/file.xlsx; a file is made in one task's memory."""
    _write(rows.select("file", "row", "cells"), folder, ".xlsx", "row", lambda pdf: xlsx_file([list(c) for c in pdf["cells"]]))


def write_docx(rows: DataFrame, folder: str) -> None:
    """(file, pos, style, text) as folder/file.docx; a file is made in one task's memory."""
    _write(rows.select("file", "pos", "style", "text"), folder, ".docx", "pos", lambda pdf: docx_file(list(zip(pdf["style"], pdf["text"], strict=True))))
