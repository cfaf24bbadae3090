"""Tables that run over pages: cleaning, headers, stitching, and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_key, word_count
from .windows import WindowConfig, windows

FRAGMENT = "page int, headers array<string>, rows array<array<string>>"


def clean(rows: Column) -> Column:
    """Cells trimmed, null as empty, rows without any text dropped."""
    trimmed = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    return F.filter(trimmed, lambda r: F.exists(r, lambda c: c != ""))


def split_headers(tables: DataFrame) -> DataFrame:
    """(…, cells) to headers and rows: a single row is headers; the first of several is if any of its cells has text that
    isn't a number; else headers are Col1, Col2, ..."""
    labels = F.exists(F.col("cells")[0], lambda c: (c != "") & ~F.regexp_replace(c, "[.,-]", "").rlike(r"^\p{N}+$"))
    auto = F.transform(F.sequence(F.lit(1), F.size(F.col("cells")[0])), lambda i: F.concat(F.lit("Col"), i))
    some = tables.withColumn("cells", clean(F.col("cells"))).filter(F.size("cells") > 0)
    head = (F.size("cells") < 2) | labels
    rest = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    return some.withColumn("headers", F.when(head, F.col("cells")[0]).otherwise(auto)).withColumn("rows", F.when(head, rest).otherwise(F.col("cells"))).drop("cells")


def stitch(fragments: DataFrame, most_pages: int = 3, tolerance: int = 1, strip_repeated: bool = True, keep_headerless: bool = False) -> DataFrame:
    """(doc_id, page, table_index, headers, rows) to (doc_id, table_no, page_start, page_end, headers, rows).

    A fragment continues the table before it if it stands on the page after that one's end, the whole spans at most
    `most_pages`, and the column counts differ by at most `tolerance`; a first row equal to the headers goes. What is
    decided depends on all before, so each document's fragments are folded in order. keep_headerless: the headers
    of a fragment that continues another are data, unless they repeat that one's.
    """
    if most_pages < 1 or tolerance < 0:
        raise ValueError("most_pages must be at least 1 and tolerance at least 0")

    def fold(part):
        import pandas as pd

        same = lambda a, b: [x.strip().lower() for x in a] == [x.strip().lower() for x in b]
        done = []
        for f in part.sort_values(["page", "table_index"]).itertuples():
            headers, rows = list(f.headers), [list(r) for r in f.rows]
            now = done[-1] if done else None
            if now and f.page == now["page_end"] + 1 and f.page - now["page_start"] < most_pages and abs(len(headers) - len(now["headers"])) <= tolerance:
                if keep_headerless and not same(headers, now["headers"]):
                    rows = [headers, *rows]
                if strip_repeated and rows and same(rows[0], now["headers"]):
                    rows = rows[1:]
                if rows:
                    now["rows"] += rows
                    now["page_end"] = f.page
                    now["fragments"] += 1
            else:
                done.append({"doc_id": f.doc_id, "table_no": len(done), "page_start": f.page, "page_end": f.page, "fragments": 1, "headers": headers, "rows": rows})
        return pd.DataFrame(done)

    kind = fragments.schema["doc_id"].dataType.simpleString()
    return fragments.select("doc_id", "page", "table_index", "headers", "rows").groupBy("doc_id").applyInPandas(fold, f"doc_id {kind}, table_no int, page_start int, page_end int, fragments int, headers array<string>, rows array<array<string>>")


def markdown(headers: Column, rows: Column) -> Column:
    """A table of pipes with padded columns."""
    all_rows = F.concat(F.array(headers), rows)
    fitted = F.transform(all_rows, lambda r: F.transform(F.sequence(F.lit(0), F.size(headers) - 1), lambda i: F.coalesce(F.try_element_at(r, i + 1), F.lit(""))))
    widths = F.transform(F.sequence(F.lit(0), F.size(headers) - 1), lambda i: F.greatest(F.lit(3), F.array_max(F.transform(fitted, lambda r: F.length(r[i])))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, widths, lambda c, w: F.rpad(c, w, " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    return F.concat_ws("\n", line(fitted[0]), rule, F.array_join(F.transform(F.slice(fitted, 2, F.greatest(F.size(rows), F.lit(0))), line), "\n"))


def _quoted(c: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(c))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def as_json(headers: Column, rows: Column) -> Column:
    """A list of objects, indented by two; of equal headers the first gives the place and the last the value."""
    names = F.array_distinct(headers)

    def record(row: Column) -> Column:
        seen = F.reverse(F.slice(headers, 1, F.least(F.size(headers), F.size(row))))
        has = F.filter(names, lambda h: F.array_contains(seen, h))
        fields = F.transform(has, lambda h: F.concat(F.lit("    "), _quoted(h), F.lit(": "), F.coalesce(_quoted(F.element_at(row, (F.size(seen) + 1 - F.array_position(seen, h)).cast("int"))), F.lit("null"))))
        return F.when(F.size(has) == 0, "  {}").otherwise(F.concat(F.lit("  {\n"), F.array_join(fields, ",\n"), F.lit("\n  }")))

    return F.when(F.size(rows) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(rows, record), ",\n"), F.lit("\n]")))


def as_csv(headers: Column, rows: Column) -> Column:
    """Headers and rows with commas; cells with a comma, a quote or a line break are quoted. White space around all goes."""
    cell = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    line = lambda r: F.when((F.size(r) == 1) & (F.coalesce(r[0], F.lit("")) == ""), '""').otherwise(F.array_join(F.transform(r, cell), ","))
    return F.regexp_replace(F.array_join(F.transform(F.concat(F.array(headers), rows), line), "\r\n"), r"^\s+|\s+$", "")


def table_chunks(stitched: DataFrame, form: str = "markdown", min_rows: int = 2) -> DataFrame:
    """A chunk for each table of at least min_rows rows."""
    forms = {"markdown": markdown, "json": as_json, "csv": as_csv}
    if form not in forms:
        raise ValueError("form must be markdown, json or csv")
    rows = stitched.filter(F.size("rows") >= min_rows).withColumn("text", forms[form](F.col("headers"), F.col("rows")))
    rows = rows.withColumns({"chunk_index": F.col("table_no"), "token_count": word_count(F.col("text")), "row_count": F.size("rows"), "col_count": F.size("headers"), "stitched": F.col("fragments") > 1})
    rows = rows.withColumn("chunk_id", content_key(F.col("doc_id"), F.lit("table"), F.col("table_no"), F.col("text")))
    return rows.select("chunk_id", "doc_id", "text", "chunk_index", "token_count", "row_count", "col_count", "stitched", "page_start", "page_end")


def tables_and_text(stitched: DataFrame, texts: DataFrame, c: WindowConfig = WindowConfig(min_size=10), form: str = "markdown", min_rows: int = 2) -> DataFrame:
    """Chunks of a document's tables and then of its free text (doc_id, text), numbered on from the tables."""
    found = table_chunks(stitched, form, min_rows).select("doc_id", "text", F.col("chunk_index").alias("place"), "token_count", F.lit("table").alias("kind"))
    found = found.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1).drop("place")
    number = found.groupBy("doc_id").agg(F.count("*").alias("tables"))
    free = windows(texts.select("doc_id", F.col("text").alias("free")), "free", c, "place", "text", "token_count").join(number, "doc_id", "left")
    free = free.select("doc_id", "text", "token_count", F.lit("text").alias("kind"), (F.col("place") + F.coalesce("tables", F.lit(0))).cast("int").alias("chunk_index"))
    rows = found.unionByName(free)
    return rows.select(content_key(F.col("doc_id"), F.col("kind"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "doc_id", "text", "chunk_index", "token_count", "kind")


def parse_pipes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) whose first line has a pipe, to (doc_id, cells): lines that start with one, without rules."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^[-|: ]*$"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    return docs.filter(F.split("text", "\n")[0].contains("|")).select("doc_id", cells.alias("cells"))
