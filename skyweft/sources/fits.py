"""FITS readers as Python Data Sources: headers, binary tables, image blocks.

Files are planned as byte ranges from their sizes alone, so one large file is
many tasks and the driver opens only the first table for the schema. A task reads
the table rows, or the image bands, that begin in its range; only the requested
columns or rows are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The file format.
BLOCK = 2880
CARD = 80
RANGE_BYTES = 64 << 20
TFORM = re.compile(r"(\d*)([LXBIJKAEDCMPQ])")
TFORM_BYTES = {"L": 1, "X": 1, "B": 1, "A": 1, "I": 2, "J": 4, "K": 8, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}
TFORM_NUMPY = {"B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">f4", "M": ">f8", "L": "u1"}
TFORM_SQL = {"L": "boolean", "B": "smallint", "I": "smallint", "J": "int", "K": "bigint", "E": "float", "D": "double",
             "C": "struct<re:float,im:float>", "M": "struct<re:double,im:double>"}
TFORM_ARROW = {"L": pa.bool_(), "B": pa.int16(), "I": pa.int16(), "J": pa.int32(), "K": pa.int64(),
               "E": pa.float32(), "D": pa.float64()}
BITPIX_NUMPY = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def round_up(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


class ForwardFile:
    """A compressed file read from start to end: seeking forward skips by reading."""

    SKIP = 1 << 20

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()

    def tell(self) -> int:
        return self.at

    def read(self, size: int) -> bytes:
        parts = []
        while size > 0 and (got := self.stream.read(size)):
            parts.append(got)
            size -= len(got)
            self.at += len(got)
        return b"".join(parts)

    def seek(self, to: int) -> None:
        if to < self.at:
            raise ValueError("a compressed file is read forward only")
        while self.at < to and self.read(min(self.SKIP, to - self.at)):
            pass


def is_compressed(path: str) -> bool:
    return path.lower().endswith(".gz")


def open_input(path: str):
    fs, where = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        pafs.LocalFileSystem(), path)
    if is_compressed(path):
        return ForwardFile(fs.open_input_stream(where, compression="gzip"))
    return fs.open_input_file(where)


def list_paths(path: str, pattern: str = "*.fits") -> list[str]:
    uri = "://" in path or path.startswith("file:")
    fs, where = pafs.FileSystem.from_uri(path) if uri else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(where)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(where))
             if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern)]
    prefix = path.split("://", 1)[0] + "://" if "://" in path else ""
    return sorted(prefix + p for p in found)


def card_value(card: str):
    """Value of a 'KEY     = value / comment' card; None for other cards."""
    if card[8:10] != "= ":
        return None
    body = card[10:]
    if body.lstrip().startswith("'"):
        quoted = re.match(r"\s*'((?:[^']|'')*)'", body)
        if quoted:
            return quoted.group(1).replace("''", "'").strip()
    text = body.split("/", 1)[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for parse in (int, lambda t: float(t.replace("D", "E").replace("d", "e"))):
        try:
            return parse(text)
        except ValueError:
            continue
    return text or None


def card_comment(card: str) -> str | None:
    if card[8:10] != "= ":
        return None
    rest = re.sub(r"^\s*'(?:[^']|'')*'", "", card[10:])
    return rest.split("/", 1)[1].strip() if "/" in rest else None


def read_cards(f) -> list[str] | None:
    """80-character cards up to END; None at end of file."""
    cards: list[str] = []
    while True:
        block = f.read(BLOCK)
        if not block:
            return None
        if len(block) != BLOCK:
            raise ValueError("truncated header block")
        text = block.decode("ascii", errors="replace")
        for i in range(0, BLOCK, CARD):
            card = text[i:i + CARD]
            if card[:8].rstrip() == "END":
                return cards
            cards.append(card)


def cards_dict(cards: list[str]) -> dict:
    out = {}
    for card in cards:
        key = card[:8].strip()
        value = card_value(card)
        if key and key not in ("COMMENT", "HISTORY") and value is not None:
            out[key] = value
    return out


@dataclass
class Hdu:
    index: int
    cards: list[str]
    header: dict
    data_start: int
    data_bytes: int

    @property
    def name(self) -> str:
        return str(self.header.get("EXTNAME", "")).strip()

    @property
    def shape(self) -> tuple[int, ...]:
        n = int(self.header.get("NAXIS", 0))
        return tuple(int(self.header[f"NAXIS{i}"]) for i in range(n, 0, -1))

    @property
    def is_table(self) -> bool:
        return self.header.get("XTENSION") == "BINTABLE"


def hdus_of(f) -> Iterator[Hdu]:
    """Headers of an open file in order; data parts are skipped by seeking. Where an
    HDU is handed out, the file stands at its data."""
    index = 0
    while True:
        cards = read_cards(f)
        if cards is None:
            return
        header = cards_dict(cards)
        n = int(header.get("NAXIS", 0))
        size = 0
        if n > 0:
            size = abs(int(header["BITPIX"])) // 8
            for i in range(1, n + 1):
                size *= int(header[f"NAXIS{i}"])
            size = int(header.get("GCOUNT", 1)) * (size + int(header.get("PCOUNT", 0)))
        start = f.tell()
        yield Hdu(index, cards, header, start, size)
        f.seek(start + round_up(size))
        index += 1


def scan_hdus(path: str) -> Iterator[Hdu]:
    with open_input(path) as f:
        yield from hdus_of(f)


# -- headers -----------------------------------------------------------------------

@dataclass
class FilePart(InputPartition):
    path: str


class HeaderReader(DataSourceReader):
    def __init__(self, paths):
        self.paths = paths

    def partitions(self):
        return [FilePart(p) for p in self.paths]

    def read(self, part):
        for hdu in scan_hdus(part.path):
            for card in hdu.cards:
                value = card_value(card)
                if value is not None:
                    text = ("T" if value else "F") if isinstance(value, bool) else str(value)
                    yield part.path, hdu.index, card[:8].strip(), text, card_comment(card)


class FitsHeaderSource(DataSource):
    """One row per valued header card. Options: path, pattern."""

    @classmethod
    def name(cls):
        return "fits_header"

    def schema(self):
        return "path string, hdu int, key string, value string, comment string"

    def reader(self, schema):
        return HeaderReader(list_paths(self.options["path"], self.options.get("pattern", "*.fits")))


# -- binary tables -------------------------------------------------------------------

@dataclass
class TableColumn:
    name: str
    code: str
    repeat: int
    offset: int
    size: int

    @property
    def sql(self) -> str | None:
        if self.code == "A":
            return "string"
        base = TFORM_SQL.get(self.code)
        if base is None:
            return "binary"  # bit fields and array descriptors are carried raw
        return base if self.repeat == 1 else f"array<{base}>"

    def decode(self, raw: np.ndarray) -> pa.Array:
        """``raw`` is (rows, row bytes)."""
        cell = np.ascontiguousarray(raw[:, self.offset:self.offset + self.size])
        n = len(cell)
        if self.code == "A":
            values = cell.view(f"S{self.size}").ravel() if self.size else np.full(n, b"")
            return pa.array([v.decode("ascii", "replace").rstrip() for v in values], pa.string())
        if self.code not in TFORM_NUMPY:
            return pa.array([c.tobytes() for c in cell], pa.binary())
        flat = cell.view(TFORM_NUMPY[self.code]).ravel()
        if self.code == "L":
            items = pa.array(flat == ord("T"), pa.bool_())
        elif self.code in "CM":
            kind = pa.float32() if self.code == "C" else pa.float64()
            native = flat.astype(flat.dtype.newbyteorder("="))
            items = pa.StructArray.from_arrays([pa.array(native[0::2], kind), pa.array(native[1::2], kind)], ["re", "im"])
        else:
            kind = TFORM_ARROW[self.code]
            items = pa.array(flat.astype(kind.to_pandas_dtype()), kind)
        if self.repeat == 1:
            return items
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.repeat, pa.int32()), items)


def tform_bytes(tform: str) -> int:
    m = TFORM.fullmatch(tform.strip())
    if not m:
        raise ValueError(f"unsupported TFORM value: {tform}")
    repeat, code = int(m.group(1) or "1"), m.group(2)
    if code in ("P", "Q"):
        return TFORM_BYTES[code]
    return repeat * TFORM_BYTES[code]


def table_columns(header: dict) -> list[TableColumn]:
    out, offset = [], 0
    for i in range(1, int(header["TFIELDS"]) + 1):
        tform = str(header[f"TFORM{i}"]).strip()
        size = tform_bytes(tform)
        m = TFORM.fullmatch(tform)
        out.append(TableColumn(str(header.get(f"TTYPE{i}", f"col{i}")).strip(), m.group(2), int(m.group(1) or "1"),
                               offset, size))
        offset += size
    if offset != int(header["NAXIS1"]):
        raise ValueError(f"row size mismatch: computed {offset}, header {header['NAXIS1']}")
    return out


def find_table(path: str, hdus: Iterator[Hdu] | None = None) -> Hdu:
    for hdu in scan_hdus(path) if hdus is None else hdus:
        if hdu.is_table:
            return hdu
    raise ValueError(f"no binary table in {path}")


@dataclass
class ByteRange(InputPartition):
    """The rows of a file that begin in [low, high). Planning needs only sizes;
    every task reads the headers of its own file. A compressed file is one range
    without end: it cannot be entered in the middle, so one task reads it once."""

    path: str
    low: int
    high: int


def byte_ranges(paths: list[str], size: int) -> list[InputPartition]:
    out: list[InputPartition] = []
    for path in paths:
        if is_compressed(path):
            out.append(ByteRange(path, 0, 1 << 62))
            continue
        fs, where = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        total = max(1, fs.get_file_info(where).size)
        out += [ByteRange(path, low, low + size) for low in range(0, total, size)]
    return out


def rows_beginning(part: ByteRange, start: int, row_bytes: int, rows: int) -> tuple[int, int]:
    """First and end row of those that begin in the byte range."""
    first, end = (min(rows, max(0, -((start - b) // row_bytes))) for b in (part.low, part.high))
    return first, end


class TableReader(DataSourceReader):
    def __init__(self, paths, wanted, range_bytes):
        self.paths, self.wanted, self.range_bytes = paths, wanted, range_bytes

    def partitions(self):
        return byte_ranges(self.paths, self.range_bytes)

    def read(self, part):
        with open_input(part.path) as f:
            hdu = find_table(part.path, hdus_of(f))
            columns = {c.name: c for c in table_columns(hdu.header)}
            row_bytes = int(hdu.header["NAXIS1"])
            begin, end = rows_beginning(part, hdu.data_start, row_bytes, int(hdu.header["NAXIS2"]))
            step = max(1, (8 << 20) // row_bytes)  # about 8 MB per batch
            for first in range(begin, end, step):
                n = min(step, end - first)
                f.seek(hdu.data_start + first * row_bytes)
                raw = f.read(n * row_bytes)
                if len(raw) != n * row_bytes:
                    raise ValueError(f"truncated table data at row {first}")
                rows = np.frombuffer(raw, "u1").reshape(n, row_bytes)
                arrays = [columns[w].decode(rows) for w in self.wanted]
                yield pa.RecordBatch.from_arrays(arrays, self.wanted)


class FitsTableSource(DataSource):
    """Rows of the first binary table. Options: path, pattern, columns (comma
    list; nothing else is decoded), rangeBytes."""

    @classmethod
    def name(cls):
        return "fits_table"

    def _paths(self):
        paths = list_paths(self.options["path"], self.options.get("pattern", "*.fits"))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        return paths

    def _wanted(self):
        columns = table_columns(find_table(self._paths()[0]).header)
        chosen = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        by_name = {c.name: c for c in columns}
        missing = [c for c in chosen if c not in by_name]
        if missing:
            raise ValueError(f"table lacks column(s): {missing}")
        return [by_name[c] for c in chosen] if chosen else columns

    def schema(self):
        return ", ".join(f"`{c.name}` {c.sql}" for c in self._wanted())

    def reader(self, schema):
        size = int(self.options.get("rangeBytes", RANGE_BYTES))
        return TableReader(self._paths(), [f.name for f in schema.fields], size)


# -- images ---------------------------------------------------------------------------

class ImageReader(DataSourceReader):
    def __init__(self, paths, options):
        self.paths, self.o = paths, options

    def _choose(self, path: str, hdus: Iterator[Hdu]) -> Hdu:
        wanted = self.o.get("hdu", "")
        for hdu in hdus:
            if hdu.is_table or len(hdu.shape) < 2:
                continue
            if wanted == "" or (wanted.isdigit() and hdu.index == int(wanted)) or hdu.name.upper() == wanted.upper():
                return hdu
        raise ValueError(f"no 2-D image HDU {wanted!r} in {path}")

    def partitions(self):
        return byte_ranges(self.paths, int(self.o.get("rangeBytes", RANGE_BYTES)))

    def read(self, part):
        """Bands of ``block`` rows whose first row begins in the byte range."""
        with open_input(part.path) as f:
            yield from self._bands(part, f, self._choose(part.path, hdus_of(f)))

    def _bands(self, part, f, hdu: Hdu):
        size = int(self.o.get("block", 256))
        height, width = hdu.shape[-2:]
        planes = int(np.prod(hdu.shape[:-2], dtype=int))
        plane = {"first": 0, "last": planes - 1}.get(self.o.get("plane", "first"))
        if self.o.get("plane") == "squeeze":
            if planes != 1:
                raise ValueError(f"{part.path} is a cube of {planes} planes")
            plane = 0
        bitpix = int(hdu.header["BITPIX"])
        kind = np.dtype(BITPIX_NUMPY[bitpix])
        start = hdu.data_start + plane * height * width * kind.itemsize
        raw_values = self.o.get("scaled", "true").lower() == "false"
        scale, zero = (1.0, 0.0) if raw_values else (float(hdu.header.get("BSCALE", 1.0)), float(hdu.header.get("BZERO", 0.0)))
        blank = hdu.header.get("BLANK") if bitpix > 0 else None
        y_low, y_high = max(0, int(self.o.get("y0", 0))), min(height, int(self.o.get("y1", height)))
        lo, hi = max(0, int(self.o.get("x0", 0))), min(width, int(self.o.get("x1", width)))
        if hi <= lo:
            return
        row_bytes = width * kind.itemsize
        begin, end = rows_beginning(part, start, row_bytes, height)
        for y in range(begin + -begin % size, end, size):
            y0, y1 = max(y_low, y), min(y_high, y + size)
            if y1 <= y0:
                continue
            f.seek(start + y0 * row_bytes)
            stored = np.frombuffer(f.read((y1 - y0) * row_bytes), kind).reshape(y1 - y0, width)
            band = stored.astype("f8") * scale + zero
            if blank is not None:
                band[stored == int(blank)] = np.nan
            for x in range(lo - lo % size, hi, size):
                a, b = max(lo, x), min(hi, x + size)
                values = pa.array(band[:, a:b].ravel(), pa.float64(), from_pandas=True)  # NaN becomes NULL
                data = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                head = [pa.array([part.path]), pa.array([hdu.index], pa.int32())]
                ints = [pa.array([int(v)], pa.int32()) for v in (y0, a, y1 - y0, b - a)]
                yield pa.RecordBatch.from_arrays([*head, *ints, data], ["path", "hdu", "y0", "x0", "height", "width", "data"])


class FitsImageSource(DataSource):
    """Row-major pixel blocks. Options: path, pattern, hdu (index or name; default
    the first 2-D image), plane (first, last, squeeze), x0 x1 y0 y1, block, scaled."""

    @classmethod
    def name(cls):
        return "fits_image"

    def schema(self):
        return "path string, hdu int, y0 int, x0 int, height int, width int, data array<double>"

    def reader(self, schema):
        paths = list_paths(self.options["path"], self.options.get("pattern", "*.fits"))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        return ImageReader(paths, dict(self.options))


def register(spark: SparkSession) -> None:
    from ..sinks.fits import FitsTableSink

    for source in (FitsHeaderSource, FitsTableSource, FitsImageSource, FitsTableSink):
        spark.dataSource.register(source)


def header_cards(spark: SparkSession, path: str, pattern: str = "*.fits") -> DataFrame:
    register(spark)
    return spark.read.format("fits_header").option("pattern", pattern).load(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of the table; NaN and infinities become NULL, as everywhere in the engine."""
    from ..operators.catalog import nulls_for_nonfinite

    register(spark)
    reader = spark.read.format("fits_table")
    return nulls_for_nonfinite((reader.option("columns", ",".join(columns)) if columns else reader).load(path))


def read_blocks(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("fits_image").options(**{k: str(v) for k, v in options.items()}).load(path)


def to_pixels(blocks: DataFrame) -> DataFrame:
    """(path, y, x, v) from pixel blocks; NaN pixels stay as NULL."""
    from pyspark.sql import functions as F

    i = F.col("_i")
    return blocks.select("path", "y0", "x0", "width", F.posexplode("data").alias("_i", "v")).select(
        "path", (F.col("y0") + F.floor(i / F.col("width"))).cast("int").alias("y"),
        (F.col("x0") + F.pmod(i, F.col("width"))).cast("int").alias("x"), "v")


def read_pixels(spark: SparkSession, path: str, **options) -> DataFrame:
    return to_pixels(read_blocks(spark, path, **options))


def image_header(path: str, hdu: int = 0) -> dict:
    """Cards of one HDU of one file, for the small planning steps on the driver."""
    return next(h.header for h in scan_hdus(path) if h.index == hdu)
