"""Landed files: hashing, what kind of file the bytes are, and delimited text as cells."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billmill.functions.text import let, lines_of_cells
from billmill.model import MAX_UPLOAD_BYTES
from billmill.operators.skew import spread

# fixed values: the characters Windows-1252 has where Latin-1 has control codes
WINDOWS_CODES = "".join(map(chr, (
    0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E,
    0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F,
)))
WINDOWS_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
WINDOWS_UNUSED = "[\\x81\\x8d\\x8f\\x90\\x9d]"

# fixed values: the delimiters tried, best first, and the leading bytes of each kind
DELIMITERS = (",", ";", "\t", "|")
KINDS = {
    "ole": ("excel", "application/vnd.ms-excel"),
    "jpeg": ("image", "image/jpeg"),
    "png": ("image", "image/png"),
    "webp": ("image", "image/webp"),
    "heic": ("image", "image/heic"),
    "xlsx": ("excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    "csv": ("csv", "text/csv"),
}
SNIFF_BYTES = 8192
# fixed values: a zip archive ends with a record of 22 bytes and a comment of at most 65,535; its
# directory has a head of 46 bytes before each name
END_MARK, END_BYTES, MOST_COMMENT = "504B0506", 22, 65535
ENTRY_MARK, ENTRY_BYTES = "504B0102", 46
WORKBOOK = "xl/workbook.xml"


def read_landing(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES):
    """Files of a folder as (path, size_bytes, sha256, content), and the refused ones.
    The size test is on the file's metadata, so refused bytes are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sized = found.select("path", F.col("length").alias("size_bytes"), "content")
    kept = sized.filter(F.col("size_bytes") <= max_bytes)
    refused = sized.filter(F.col("size_bytes") > max_bytes).select("path", "size_bytes")
    return kept.withColumn("sha256", F.sha2("content", 256)), refused


def storage_path(sha256: Column, ext: Column) -> Column:
    return F.concat(F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit("."), ext)


def decode(content: Column) -> Column:
    """UTF-8 (with or without mark), else Windows-1252; null when it is neither."""
    latin = F.decode(content, "ISO-8859-1")
    windows = F.when(~latin.rlike(WINDOWS_UNUSED), F.translate(latin, WINDOWS_CODES, WINDOWS_CHARS))
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), r"^\ufeff", "")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(windows)


def lines_of(text: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(
        F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"),
        lambda line: line.rlike(r"\S"),
    )


def has_delimiter(line: Column, delimiter: str) -> Column:
    """A comma between digits groups thousands; it does not delimit."""
    if delimiter == ",":
        return line.rlike(r"(?<![0-9]),|,(?![0-9])")
    return F.instr(line, delimiter) > 0


def pick_delimiter(text: Column) -> Column:
    """The delimiter on the most lines; the earlier candidate wins ties."""
    lines = lines_of(text)
    votes = F.array(*[_vote(lines, i, d) for i, d in enumerate(DELIMITERS)])
    return F.array_max(votes)["delimiter"]


def _vote(lines: Column, rank: int, delimiter: str) -> Column:
    count = F.size(F.filter(lines, lambda line: has_delimiter(line, delimiter)))
    return F.struct(
        count.alias("lines"), F.lit(-rank).alias("rank"), F.lit(delimiter).alias("delimiter")
    )


def looks_like_csv(content: Column) -> Column:
    """No NUL near the start, readable text, two lines or more, and a delimiter on half of
    them."""
    head = F.substring(content, 1, SNIFF_BYTES)
    lines = lines_of(decode(head))
    marked = F.size(F.filter(lines, lambda line: line.rlike(r"[,;\t|]")))
    no_nul = F.instr(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\x00") == 0
    enough = (F.size(lines) >= 2) & (marked * 2 >= F.size(lines))
    return F.coalesce(no_nul & enough, F.lit(False))


def _little(content: Column, at: Column, size: int) -> Column:
    """The number in `size` bytes from place `at` (from 0), the lowest byte first."""
    pairs = [F.hex(F.substring(content, at + i + 1, 1)) for i in reversed(range(size))]
    return F.conv(F.concat(*pairs), 16, 10).cast("bigint")


def archive_kind(content: Column) -> Column:
    """'workbook', 'archive' or 'damaged', from the directory at the end of a zip archive's
    bytes. Only the directory is walked, one entry a step; what the files hold is not read, so
    a name inside them does not count."""
    tail = F.substring(content, -(END_BYTES + MOST_COMMENT), END_BYTES + MOST_COMMENT)
    # The last mark: what follows it holds no other.
    mark = bytes.fromhex(END_MARK).decode("latin-1")
    after = F.length(F.substring_index(F.decode(tail, "ISO-8859-1"), mark, -1))
    end = (F.length(content) - after - 4).cast("bigint")

    def found(e: Column) -> Column:
        at = e["end"]
        whole = (F.length(content) - at >= END_BYTES) & (
            F.hex(F.substring(content, at.cast("int") + 1, 4)) == END_MARK
        )
        at = at.cast("int")
        return F.struct(
            F.coalesce(whole, F.lit(False)).alias("whole"), at.alias("end"),
            _little(content, at + 10, 2).alias("entries"),
            (at - _little(content, at + 12, 4)).alias("start"),
            _little(content, at + 16, 4).alias("offset"),
        )

    def walk(d: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            at = s["at"].cast("int")
            name_bytes = _little(content, at + 28, 2)
            sound = s["sound"] & (s["at"] + ENTRY_BYTES <= d["end"]) & (
                F.hex(F.substring(content, at + 1, 4)) == ENTRY_MARK
            )
            name = F.decode(F.substring(content, at + ENTRY_BYTES + 1, name_bytes.cast("int")), "ISO-8859-1")
            more = name_bytes + _little(content, at + 30, 2) + _little(content, at + 32, 2)
            return F.when(s["sound"], F.struct(
                F.coalesce(s["at"] + ENTRY_BYTES + more, s["at"]).alias("at"),
                F.coalesce(sound, F.lit(False)).alias("sound"),
                (s["workbook"] | F.coalesce(sound & (name == WORKBOOK), F.lit(False))).alias("workbook"),
            )).otherwise(s)

        begin = F.struct(
            d["start"].alias("at"), (d["start"] >= d["offset"]).alias("sound"), F.lit(False).alias("workbook")
        )
        steps = F.when(d["entries"] > 0, F.sequence(F.lit(1), d["entries"].cast("int"))).otherwise(
            F.array().cast("array<int>")
        )
        return F.aggregate(steps, begin, step, lambda s: F.when(
            ~s["sound"] | (s["at"] > d["end"]), "damaged"
        ).when(s["workbook"], "workbook").otherwise("archive"))

    read = let(let(F.struct(end.alias("end")), found), lambda d: F.when(d["whole"], walk(d)))
    return F.coalesce(read, F.lit("damaged"))


def detect(content: Column) -> Column:
    """struct(kind, mime_type, problem) from the bytes alone. PDFs are told from their lines
    later on, so their kind is 'pdf' here."""
    start = F.hex(F.substring(content, 1, 16))

    def starts(code: str, at: int = 0) -> Column:
        return F.substring(start, at * 2 + 1, len(code)) == code

    brand = F.substring(start, 17, 8)
    heic = [F.hex(F.lit(b)) for b in ("heic", "heix", "mif1", "msf1", "hevc")]

    def is_kind(name: str) -> Column:
        kind, mime = KINDS[name]
        return answer(kind, mime)

    def answer(kind: str | None, mime: str | None, problem: str | None = None) -> Column:
        return F.struct(
            F.lit(kind).cast("string").alias("kind"),
            F.lit(mime).cast("string").alias("mime_type"),
            F.lit(problem).cast("string").alias("problem"),
        )

    def of_archive(archive: Column) -> Column:
        other = answer(None, None, "This is a zip archive, not a spreadsheet.")
        damaged = answer(None, None, "The file is damaged.")
        return F.when(archive == "workbook", is_kind("xlsx")).when(archive == "damaged", damaged).otherwise(other)

    return (
        F.when(F.coalesce(F.length(content), F.lit(0)) == 0, answer(None, None, "The file is empty."))
        .when(starts("25504446"), answer("pdf", "application/pdf"))
        .when(starts("504B0304"), let(archive_kind(content), of_archive))
        .when(starts("D0CF11E0A1B11AE1"), is_kind("ole"))
        .when(starts("FFD8FF"), is_kind("jpeg"))
        .when(starts("89504E470D0A1A0A"), is_kind("png"))
        .when(starts("52494646") & starts("57454250", 8), is_kind("webp"))
        .when(starts("66747970", 4) & brand.isin(*heic), is_kind("heic"))
        .when(looks_like_csv(content), is_kind("csv"))
        .otherwise(answer(None, None, "This file type is not supported."))
    )


def _records(text: Column) -> Column:
    """The records of a delimited text: line ends inside quotes do not end one."""
    quoted = r'(?<=[\n,;\t|])"[^"]*(?:""[^"]*)*"'
    plain = F.concat(F.lit("\n"), F.regexp_replace(text, r"\r\n?", "\n"))
    return F.regexp_extract_all(plain, F.lit(rf'\n((?:{quoted}|[^"\n]+|")*+)'), F.lit(1))


def _fields(record: Column, delimiter: str) -> Column:
    """The cells of one record. Quoted cells keep delimiters and lose their quotes."""
    d = {"|": r"\|", "\t": r"\t"}.get(delimiter, delimiter)
    cell = rf'{d}((?:(?<={d})"[^"]*(?:""[^"]*)*"|[^"{d}]+|")*+)'
    whole = r'(?s)^"(.*)"$'
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(cell), F.lit(1))
    return F.transform(
        found,
        lambda c: F.when(
            c.rlike(whole), F.replace(F.regexp_replace(c, whole, "$1"), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )


def csv_cells(files: DataFrame, file_id: str = "file_id", content: str = "text") -> DataFrame:
    """Delimited text as cells, each file with its own delimiter. Blank cells are null.
    Records may hold line breaks inside quotes; rows may have different widths. Files are
    exchanged before they are read, as reading is heavy and a scan may be one part; by their
    size, as cells take many times the room of the text they come from."""
    sample = F.substring(content, 1, SNIFF_BYTES)
    picked = spread(files, file_id, F.length(content)).select(
        file_id, F.col(content).alias("_text"), pick_delimiter(sample).alias("_d")
    )
    rows = picked.select(
        file_id, "_d", F.posexplode(_records(F.col("_text"))).alias("row", "_record")
    )
    cells = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        cells = F.when(F.col("_d") == d, _fields(F.col("_record"), d)).otherwise(cells)
    flat = rows.select(file_id, "row", F.posexplode(cells).alias("col", "_cell"))
    return flat.select(
        file_id, F.lit("csv").alias("sheet"), "row", "col",
        F.when(F.col("_cell").rlike(r"\S"), F.col("_cell")).alias("value"), F.lit(False).alias("is_number"),
    )


def trim_cells(cells: DataFrame) -> DataFrame:
    """Without the empty rows and columns at the end of each sheet. The edges are a window, not a
    join, which would read the sheets twice."""
    sheet = Window.partitionBy("file_id", "sheet")
    last = lambda at: F.max(F.when(F.col("value").isNotNull(), F.col(at))).over(sheet)
    edged = cells.withColumns({"_row": last("row"), "_col": last("col")})
    inside = (F.col("row") <= F.col("_row")) & (F.col("col") <= F.col("_col"))
    return edged.filter(inside).drop("_row", "_col")


def row_texts(cells: DataFrame, between: str = " ") -> DataFrame:
    """Each row's filled cells as one line."""
    filled = cells.filter(F.col("value").isNotNull())
    packed = F.array_sort(F.collect_list(F.struct("col", "value")))
    return filled.groupBy("file_id", "sheet", "row").agg(
        F.array_join(F.transform(packed, lambda x: x["value"]), between).alias("text")
    )


def sheet_texts(cells: DataFrame) -> DataFrame:
    """Each sheet as text, a line per row, for learning labels. The cells of a sheet meet once;
    its size is limited with the file's."""
    filled = cells.filter(F.col("value").isNotNull())
    packed = F.array_sort(F.collect_list(F.struct("row", "col", "value")))
    sheets = filled.repartition("file_id").groupBy("file_id", "sheet").agg(packed.alias("_cells"))
    return sheets.select("file_id", "sheet", lines_of_cells(F.col("_cells")).alias("text"))


def csv_texts(cells: DataFrame) -> DataFrame:
    """Each row as a comma line with quotes where needed; blank cells stay."""
    value = F.coalesce("value", F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    cell = F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)
    packed = F.array_sort(F.collect_list(F.struct("col", cell.alias("cell"))))
    return cells.groupBy("file_id", "sheet", "row").agg(
        F.array_join(F.transform(packed, lambda x: x["cell"]), ",").alias("line")
    )
