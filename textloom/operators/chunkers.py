"""Chunkers: documents to rows of chunk_id, doc_id, text, chunk_index, token_count, chunker, and what each adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_key, word_count, words
from .windows import WindowConfig, fixed_step, windows

#: Rows of a sheet, and chunks of a document that may be long, that are numbered together.
RANGE = 4096


def _finish(rows: DataFrame, chunker: str, order: list[str], extra: list[str] = (), span: int | None = None) -> DataFrame:
    """Number the chunks of each document from 0 in the given order, and key them by content.

    span: for documents of any length, such as a table that is one document: numbers are made within ranges of so many
    values of the first order column, and the counts of the ranges before are added.
    """
    if span is None:
        rows = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)
    else:
        rows = rows.withColumn("_range", F.floor(F.col(order[0]) / span))
        before = Window.partitionBy("doc_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy("doc_id", "_range").agg(F.count("*").alias("_n"))
        starts = counts.select("doc_id", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        within = F.row_number().over(Window.partitionBy("doc_id", "_range").orderBy(*order)) - 1
        rows = rows.withColumn("_within", within).join(starts, ["doc_id", "_range"]).withColumn("chunk_index", (F.col("_before") + F.col("_within")).cast("int"))
    rows = rows.withColumn("token_count", word_count(F.col("text"))).withColumn("chunker", F.lit(chunker))
    rows = rows.withColumn("chunk_id", content_key(F.col("doc_id"), F.col("chunker"), F.col("chunk_index"), F.col("text")))
    return rows.select("chunk_id", "doc_id", "text", "chunk_index", "token_count", "chunker", *extra)


def chunk_text(docs: DataFrame, c: WindowConfig = WindowConfig()) -> DataFrame:
    """Windows over the whole text of (doc_id, text)."""
    rows = windows(docs.select("doc_id", F.col("text").alias("source_text")), "source_text", c, count="token_count", source=False)
    rows = rows.select("doc_id", F.col("window").alias("text"), F.col("window_index").alias("chunk_index"), "token_count").withColumn("chunker", F.lit("text"))
    rows = rows.withColumn("chunk_id", content_key(F.col("doc_id"), F.col("chunker"), F.col("chunk_index"), F.col("text")))
    return rows.select("chunk_id", "doc_id", "text", "chunk_index", "token_count", "chunker")


def chunk_pages(pages: DataFrame, c: WindowConfig = WindowConfig(), within_page: bool = True) -> DataFrame:
    """(doc_id, page, text): windows within each page that isn't blank, or over all pages of a document joined."""
    full = pages.select("doc_id", F.col("page").cast("int").alias("page_number"), F.trim("text").alias("page_text")).filter(F.col("page_text") != "")
    if within_page:
        rows = windows(full, "page_text", c, source=False).withColumnRenamed("window", "text")
        return _finish(rows, "pages", ["page_number", "window_index"], ["page_number"])
    whole = full.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_text"))).alias("p"))
    rows = whole.select("doc_id", F.array_join(F.col("p.page_text"), "\n\n").alias("page_text"))
    return _finish(windows(rows, "page_text", c, source=False).withColumnRenamed("window", "text"), "pages", ["window_index"])


def _sections(lines: DataFrame, is_heading: Column, heading: Column, level: Column, glue: str) -> DataFrame:
    """(doc_id, pos, line) to one row per run of lines under a heading: section, heading, level, body."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.withColumn("h", is_heading).withColumn("section", F.sum(F.col("h").cast("int")).over(order))
    body = F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("pos", "line"))))
    out = marked.groupBy("doc_id", "section").agg(F.max(F.when(F.col("h"), heading)).alias("heading"), F.max(F.when(F.col("h"), level)).alias("level"), body.alias("b"))
    return out.withColumn("body", F.trim(F.regexp_replace(F.array_join(F.col("b.line"), glue), r"^\s+|\s+$", ""))).drop("b")


def chunk_headings(docs: DataFrame, c: WindowConfig = WindowConfig(), levels: tuple[int, ...] = (1, 2, 3), include_header: bool = True, repeat_header: bool = False) -> DataFrame:
    """Markdown split at `#` headings of the given levels. The first window of a section holds its heading;
    repeat_header: every one does. Text before the first heading has none; a heading alone is a chunk."""
    if not levels or not set(levels) <= set(range(1, 7)):
        raise ValueError("levels must be some of 1 to 6")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})\s+.+$", 1))
    parts = _sections(lines, marks.isin(*levels), F.regexp_replace("line", r"^\s+|\s+$", ""), marks, "\n")
    return _windows_of_sections(parts, c, "markdown", include_header, repeat_header, lone=True)


def chunk_paragraphs(paragraphs: DataFrame, c: WindowConfig = WindowConfig(), include_header: bool = True, repeat_header: bool = False) -> DataFrame:
    """(doc_id, pos, style, text): paragraphs under the nearest heading before them; a style that starts with Heading or
    Title makes one. A heading without a body gives nothing."""
    rows = paragraphs.select("doc_id", "pos", F.trim("text").alias("line"), F.coalesce("style", F.lit("")).alias("style")).filter("line <> ''")
    level = F.coalesce(F.expr("try_cast(regexp_extract(style, '([0-9]+)', 1) as int)"), F.lit(1))
    parts = _sections(rows, F.col("style").rlike("^(Heading|Title)"), F.col("line"), level, " ").filter("body <> ''")
    return _windows_of_sections(parts, c, "paragraphs", include_header, repeat_header, lone=False)


def _windows_of_sections(parts: DataFrame, c: WindowConfig, chunker: str, include: bool, repeat: bool, lone: bool) -> DataFrame:
    has = F.col("heading").isNotNull() & F.lit(include)
    whole = F.when(has & ~F.lit(repeat), F.concat_ws("\n", "heading", "body")).otherwise(F.when(F.lit(lone) & has & (F.col("body") == ""), F.col("heading")).otherwise(F.col("body")))
    rows = windows(parts.withColumn("section_text", whole).drop("body"), "section_text", c, source=False)
    text = F.when(has & F.lit(repeat) & (F.col("window") != F.col("heading")), F.concat_ws(" ", "heading", "window")).otherwise(F.col("window"))
    return _finish(rows.withColumn("text", text), chunker, ["section", "window_index"], ["heading", "level"])


def chunk_hybrid(units: DataFrame, c: WindowConfig = WindowConfig(), max_unit: int = 1000) -> DataFrame:
    """Chunks of another chunker: one within both limits stays whole, a longer one is windowed; then renumbered."""
    base = units.select("doc_id", F.col("chunk_index").alias("unit"), F.col("text").alias("unit_text"), F.col("chunker").alias("source_chunker"), "token_count")
    small = F.col("token_count") <= min(max_unit, c.size)
    whole = base.filter(small).select("doc_id", "unit", F.lit(0).alias("window_index"), F.col("unit_text").alias("text"), "source_chunker", F.lit("structural").alias("pass"))
    cut = windows(base.filter(~small), "unit_text", c, source=False).select("doc_id", "unit", "window_index", F.col("window").alias("text"), "source_chunker", F.lit("token_window").alias("pass"))
    return _finish(whole.unionByName(cut), "hybrid", ["unit", "window_index"], ["source_chunker", "pass"])


# ---- sheets -------------------------------------------------------------------------------------------------------


def _cells(sheet: DataFrame, headers: list[str] | None) -> Column:
    """The cells of a row that count, as (column number, header, value): blank, nan and none don't. Without headers the
    sheet has them so in a column `cells`."""
    if headers is None:
        cells = F.transform("cells", lambda x: F.struct(x["col"].alias("col"), x["header"].alias("header"), F.trim(x["value"]).alias("value")))
    else:
        cells = F.array(*[F.struct(F.lit(k).alias("col"), F.lit(h).alias("header"), F.trim(F.col(f"`{h}`").cast("string")).alias("value")) for k, h in enumerate(headers)])
    return F.filter(cells, lambda x: x["value"].isNotNull() & ~F.lower(x["value"]).isin("", "nan", "none"))


def chunk_rows(sheet: DataFrame, headers: list[str] | None, row: str, doc_id: Column, group: int = 10, c: WindowConfig = WindowConfig(overlap=0, boundary=False, min_size=10)) -> DataFrame:
    """`Header: Value | ...` lines in groups of `group` rows (numbered from 0 by `row`); a group over c.size is windowed."""
    if group < 1:
        raise ValueError("group must be at least 1")
    cells = F.transform(_cells(sheet, headers), lambda x: F.concat_ws(": ", x["header"], x["value"]))
    rows = sheet.select(doc_id.alias("doc_id"), F.col(row).alias("row"), F.array_join(cells, " | ").alias("line")).filter("line <> ''")
    groups = rows.groupBy("doc_id", F.floor(F.col("row") / group).cast("int").alias("unit")).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("r"))
    text = groups.select("doc_id", "unit", F.array_join(F.col("r.line"), "\n").alias("unit_text"))
    large = word_count(F.col("unit_text")) > c.size
    whole = text.filter(~large).select("doc_id", "unit", F.lit(0).alias("window_index"), F.col("unit_text").alias("text"))
    cut = windows(text.filter(large), "unit_text", c, source=False).select("doc_id", "unit", "window_index", F.col("window").alias("text"))
    return _finish(whole.unionByName(cut), "sheet_rows", ["unit", "window_index"], [(F.col("unit") * group).alias("row_group_start")], span=RANGE)


def chunk_columns(sheet: DataFrame, headers: list[str] | None, row: str, doc_id: Column, c: WindowConfig = WindowConfig(overlap=0, boundary=False, min_size=10)) -> DataFrame:
    """`Column: h` and the values below it, always windowed. Windows of words without boundaries are put together from their
    own cells, so no row or task holds a column; other windows depend on all before them and take a column as one row."""
    rows = sheet.select(doc_id.alias("doc_id"), F.col(row).alias("row"), F.explode(_cells(sheet, headers)).alias("x")).select("doc_id", "row", "x.*")
    if not c.boundary and c.counter == "word_count":
        return _finish(_column_windows(rows, c), "sheet_columns", ["unit"], ["header"], span=RANGE)
    cols = rows.groupBy("doc_id", "col", "header").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("v"))
    text = cols.select("doc_id", "col", "header", F.concat(F.lit("Column: "), F.col("header"), F.lit("\n"), F.array_join(F.col("v.value"), "\n")).alias("unit_text"))
    return _finish(windows(text, "unit_text", c, source=False).withColumnRenamed("window", "text"), "sheet_columns", ["col", "window_index"], ["header"])


def _column_windows(cells: DataFrame, c: WindowConfig) -> DataFrame:
    """(doc_id, header, unit, text) of cells (doc_id, row, col, header, value); units go by column and then by window.

    A cell's first word has its place from the words before it in its range of rows, and those of the ranges before; it gives
    its words to each window that they are in.
    """
    key, step = ["doc_id", "col", "header"], fixed_step(c)
    heads = cells.select(*key).distinct().select(*key, F.lit(None).cast("long").alias("row"), F.concat(F.lit("Column: "), F.col("header")).alias("value"))
    each = cells.select(*key, F.col("row").cast("long").alias("row"), "value").unionByName(heads)
    each = each.select(*key, "row", "value", F.coalesce(F.floor(F.col("row") / RANGE), F.lit(-1)).alias("_range"), words(F.col("value")).alias("_words"))
    each = each.withColumn("_n", F.size("_words"))
    counts = each.groupBy(*key, "_range").agg(F.sum("_n").alias("_of"))
    order, column = Window.partitionBy(*key).orderBy("_range"), Window.partitionBy(*key)
    starts = counts.select(*key, "_range", (F.sum("_of").over(order) - F.col("_of")).alias("_before"), F.sum("_of").over(column).alias("_all"))
    within = Window.partitionBy(*key, "_range").orderBy("row", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("_end", F.sum("_n").over(within)).join(starts, [*key, "_range"])
    placed = placed.withColumn("_end", F.col("_end") + F.col("_before")).withColumn("_start", F.col("_end") - F.col("_n"))
    last = F.when(F.col("_all") <= c.size, F.lit(0)).otherwise(F.ceil((F.col("_all") - c.size) / step))
    first = F.greatest(F.lit(0), F.floor((F.col("_start") - c.size) / step) + 1)
    upto = F.least(last, F.floor((F.col("_end") - 1) / step))
    rows = placed.filter("_n > 0").withColumn("_first", first).withColumn("_upto", upto).filter("_first <= _upto")
    rows = rows.withColumn("window_index", F.explode(F.sequence("_first", "_upto")))
    begin = F.greatest(F.col("_start"), F.col("window_index") * step)
    size = F.least(F.col("_end"), F.col("window_index") * step + c.size) - begin
    piece = F.slice("_words", (begin - F.col("_start") + 1).cast("int"), size.cast("int"))
    made = rows.select(*key, "window_index", begin.alias("_at"), piece.alias("_piece")).groupBy(*key, "window_index").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
    unit = F.shiftleft(F.col("col").cast("long"), 32) + F.col("window_index")
    return made.select("doc_id", "header", unit.alias("unit"), F.array_join(F.flatten("_p._piece"), " ").alias("text"))


def chunk_cells(sheet: DataFrame, headers: list[str] | None, row: str, doc_id: Column) -> DataFrame:
    """One chunk `header: value` for each cell that isn't blank, row by row."""
    rows = sheet.select(doc_id.alias("doc_id"), F.col(row).alias("row"), F.explode(_cells(sheet, headers)).alias("x")).select("doc_id", "row", "x.*")
    return _finish(rows.withColumn("text", F.concat_ws(": ", "header", "value")), "sheet_cells", ["row", "col"], ["row", "header"], span=RANGE)


def parse_delimited(docs: DataFrame, header_rows: int = 1) -> DataFrame:
    """(doc_id, text) to (doc_id, row, col, header, value): tab-separated if the first line has a tab, else commas, split
    plainly. Without header rows the headers are Col1, Col2, ...; of several header rows the first names the columns."""
    lines = docs.withColumn("lines", F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")).filter(F.size("lines") > 0)
    lines = lines.withColumn("sep", F.when(F.col("lines")[0].contains("\t"), "\t").otherwise(","))
    named = lines.withColumn("headers", F.split(F.col("lines")[0], F.col("sep")))
    rows = named.select("doc_id", "headers", "sep", F.posexplode(F.slice("lines", header_rows + 1, F.greatest(F.lit(0), F.size("lines") - header_rows))).alias("row", "line"))
    cells = rows.select("doc_id", "row", "headers", F.posexplode(F.split("line", F.col("sep"))).alias("col", "value"))
    header = F.concat(F.lit("Col"), F.col("col") + 1) if header_rows == 0 else F.coalesce(F.trim(F.try_element_at("headers", F.col("col") + 1)), F.concat(F.lit("Col"), F.col("col") + 1))
    return cells.select("doc_id", "row", "col", header.alias("header"), F.trim("value").alias("value"))


# ---- images -------------------------------------------------------------------------------------------------------


def chunk_images(regions: DataFrame, min_area: int = 5000) -> DataFrame:
    """(doc_id, page, image_index, width, height, ext): a placeholder chunk for each region of at least min_area. Where the
    regions hold `bytes`, the chunks hold them as image_base64."""
    rows = regions.filter(F.col("width") * F.col("height") >= min_area)
    text = F.format_string("[Image %d on page %d: %dx%d %s]", "image_index", "page", "width", "height", "ext")
    more = ["page", "image_index", "width", "height", "ext"]
    if "bytes" in regions.columns:
        rows, more = rows.withColumn("image_base64", F.base64("bytes")), [*more, "image_base64"]
    return _finish(rows.withColumn("text", text), "images", ["page", "image_index"], more)


def chunk_image_pages(pages: DataFrame, regions: DataFrame, c: WindowConfig = WindowConfig(min_size=20), handling: str = "extract", min_area: int = 5000, captioner: Column | None = None) -> DataFrame:
    """Recognised text (doc_id, page, text) and image regions as chunks of one numbering, a page's text before its images.

    handling: skip gives text only, extract and both give text and images, caption gives captioned images only. Text is
    what an injected recogniser made of the pages.
    """
    if handling not in ("skip", "extract", "both", "caption"):
        raise ValueError("handling must be skip, extract, both or caption")
    parts = []
    if handling != "caption":
        text = chunk_pages(pages, c).select("doc_id", "text", F.col("page_number").alias("page"), F.lit(0).alias("part"), F.col("chunk_index").alias("place"), F.lit(False).alias("is_image"))
        parts.append(text)
    if handling != "skip":
        images = chunk_images(regions, min_area)
        images = caption(images, captioner) if handling == "caption" else images
        parts.append(images.select("doc_id", "text", F.col("page").cast("int").alias("page"), F.lit(1).alias("part"), F.col("image_index").cast("int").alias("place"), F.lit(True).alias("is_image")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _finish(rows, "image_pages", ["page", "part", "place"], ["page", "is_image"])


def caption(chunks: DataFrame, captioner: Column | None = None, on_failure: str = "placeholder") -> DataFrame:
    """Image chunks with the text that an injected captioner column gives; where it is null the placeholder stays, or
    with on_failure="raise" the job fails. token_count follows the text."""
    if on_failure not in ("placeholder", "raise"):
        raise ValueError("on_failure must be placeholder or raise")
    said = captioner if captioner is not None else F.lit(None).cast("string")
    text = F.coalesce(said, F.col("text") if on_failure == "placeholder" else F.raise_error(F.lit("captioning failed")).cast("string"))
    return chunks.withColumn("text", text).withColumn("captioned", F.lit(True)).withColumn("token_count", word_count(F.col("text")))
