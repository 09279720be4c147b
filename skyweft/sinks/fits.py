"""FITS writers: one valid table file per task, images assembled per file key."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BLOCK = 2880
SQL_TFORM = {"boolean": "L", "tinyint": "B", "smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D"}
TFORM_NUMPY = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}


def card(key: str, value, comment: str | None = None) -> str:
    if isinstance(value, bool):
        body = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        body = f"{int(value):>20d}"
    elif isinstance(value, (float, np.floating)):
        body = f"{float(value)!r:>20}".replace("e", "E")
    else:
        quoted = str(value).replace("'", "''")
        body = f"'{quoted:<8}'"
    text = f"{key:<8}= {body}"
    if comment:
        text += f" / {comment}"
    return text[:80].ljust(80)


def note(key: str, text: str) -> str:
    return f"{key:<8}{text}"[:80].ljust(80)


def header_bytes(cards: Sequence[str]) -> bytes:
    payload = "".join([*cards, "END".ljust(80)]).encode("ascii", "replace")
    return payload + b" " * (-len(payload) % BLOCK)


def padded(data: bytes) -> bytes:
    return data + b"\x00" * (-len(data) % BLOCK)


PRIMARY = [card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True)]


def resized_table_header(cards: Sequence[str], rows: int) -> list[str]:
    """Copy of a table header for another row count; checksums no longer hold
    and are dropped, the comment of NAXIS2 stays."""
    from ..sources.fits import card_comment

    out, done = [], False
    for c in cards:
        key = c[:8].strip()
        if key in ("CHECKSUM", "DATASUM", "END"):
            continue
        if key == "NAXIS2":
            c, done = card("NAXIS2", rows, card_comment(c)), True
        out.append(c)
    return out if done else [*out, card("NAXIS2", rows)]


def table_layout(schema: T.StructType, widths: dict[str, int]) -> list[tuple[str, str, int]]:
    """(name, TFORM, bytes) per column; strings need a declared width."""
    out = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        if kind == "string":
            width = widths.get(f.name, 0)
            if width <= 0:
                raise ValueError(f"string column {f.name} needs a width option")
            out.append((f.name, f"{width}A", width))
        elif kind in SQL_TFORM:
            code = SQL_TFORM[kind]
            out.append((f.name, code, np.dtype(TFORM_NUMPY[code]).itemsize))
        else:
            raise ValueError(f"column {f.name} of type {kind} has no table form")
    return out


def encode_rows(batch: pa.RecordBatch, layout) -> bytes:
    dtype = np.dtype([(n, f"S{w}" if t.endswith("A") else TFORM_NUMPY[t]) for n, t, w in layout])
    rows = np.zeros(batch.num_rows, dtype)
    for name, tform, width in layout:
        column = batch.column(batch.schema.get_field_index(name))
        if tform.endswith("A"):
            values = [(v or "").encode("ascii", "replace") for v in column.to_pylist()]
            if any(len(v) > width for v in values):
                raise ValueError(f"text in {name} is longer than {width}")
            rows[name] = np.array([v.ljust(width) for v in values], f"S{width}") if values else rows[name]
        elif tform == "L":
            rows[name] = [{True: ord("T"), False: ord("F")}.get(v, 0) for v in column.to_pylist()]
        elif tform in "ED":
            rows[name] = column.to_numpy(zero_copy_only=False)  # NULL becomes NaN
        else:
            if column.null_count:
                raise ValueError(f"integer column {name} holds NULLs, which the format cannot store")
            rows[name] = column.to_numpy(zero_copy_only=False)
    return rows.tobytes()


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, so that tasks write where readers look."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


#: Cards that the writer sets itself; all others of a source header are kept.
STRUCTURE = ("SIMPLE", "XTENSION", "BITPIX", "PCOUNT", "GCOUNT", "TFIELDS", "THEAP", "END")


def kept_cards(cards: Sequence[str]) -> list[str]:
    """Cards of a source table that still hold for a subset of its rows."""
    own = (*STRUCTURE, "NAXIS", "TTYPE", "TFORM", "TSCAL", "TZERO", "TNULL", "TDIM")
    return [c for c in cards if not c[:8].strip().startswith(own) and c[:8].strip() not in STRUCTURE]


class TableWriter(DataSourceArrowWriter):
    """Tasks write drafts; the driver's commit moves those of the successful
    attempts to their names and removes all others."""

    def __init__(self, options, schema, overwrite):
        self.folder = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.cards = json.loads(options.get("cards", "[]"))
        widths = {k.removeprefix("width."): int(v) for k, v in options.items() if k.startswith("width.")}
        lower = {k.lower(): v for k, v in widths.items()}
        named = {f.name: lower[f.name.lower()] for f in schema.fields if f.name.lower() in lower}
        self.layout = table_layout(schema, named)
        self.run = uuid.uuid4().hex[:12]

    def _head(self, rows: int) -> bytes:
        size = sum(w for _, _, w in self.layout)
        cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", size),
                 card("NAXIS2", rows), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(self.layout))]
        for i, (name, tform, _) in enumerate(self.layout, 1):
            cards += [card(f"TTYPE{i}", name), card(f"TFORM{i}", tform)]
        return header_bytes(PRIMARY) + header_bytes(cards + kept_cards(self.cards))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = file_system(self.folder)
        draft = f"{folder}/_attempt-{self.run}-{task.partitionId():05d}-{task.taskAttemptId()}"
        rows = 0
        with tempfile.TemporaryFile() as body:  # the header needs the number of rows first
            for batch in batches:
                body.write(encode_rows(batch, self.layout))
                rows += batch.num_rows
            if rows == 0:
                return Written("", 0)
            body.write(b"\x00" * (-body.tell() % BLOCK))
            body.seek(0)
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(draft) as out:
                out.write(self._head(rows))
                while piece := body.read(1 << 22):
                    out.write(piece)
        return Written(draft, rows)

    def _clear(self, keep: set[str], old: bool) -> None:
        fs, folder = file_system(self.folder)
        for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            name = f.base_name
            if f.path not in keep and (name.startswith(f"_attempt-{self.run}-") or (old and name.startswith("part-"))):
                fs.delete_file(f.path)

    def commit(self, messages) -> None:
        drafts = {m.path for m in messages if m is not None and m.path}
        self._clear(drafts, self.overwrite)
        fs, folder = file_system(self.folder)
        for draft in sorted(drafts):
            part = draft.rsplit("/", 1)[1].split("-")[2]
            fs.move(draft, f"{folder}/part-{part}-{self.run}.fits")

    def abort(self, messages) -> None:
        self._clear(set(), False)


class FitsTableSink(DataSource):
    """Folder of binary-table files, one per non-empty task. Options: path,
    width.<column> for strings, cards (a JSON list of header cards to keep)."""

    @classmethod
    def name(cls):
        return "fits_table_sink"

    def writer(self, schema, overwrite):
        return TableWriter(dict(self.options), schema, overwrite)


def write_table(df: DataFrame, folder: str, widths: dict[str, int] | None = None, cards: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write the rows; ``cards`` are those of the table they came from. A second
    run replaces the files of the first unless ``mode`` is append."""
    from ..sources.fits import register

    register(df.sparkSession)
    writer = df.write.format("fits_table_sink").mode(mode).option("cards", json.dumps(list(cards)))
    for k, v in (widths or {}).items():
        writer = writer.option(f"width.{k}", v)
    writer.save(folder)


# -- images ---------------------------------------------------------------------------

def image_hdu(data: np.ndarray, cards: Sequence[str] = (), name: str | None = None, primary: bool = False) -> bytes:
    kind = {"float32": -32, "float64": -64, "int16": 16, "int32": 32, "uint8": 8}[data.dtype.name]
    head = [card("SIMPLE", True)] if primary else [card("XTENSION", "IMAGE")]
    head += [card("BITPIX", kind), card("NAXIS", 2), card("NAXIS1", data.shape[1]), card("NAXIS2", data.shape[0])]
    if not primary:
        head += [card("PCOUNT", 0), card("GCOUNT", 1)]
    if name:
        head.append(card("EXTNAME", name))
    skip = ("SIMPLE", "XTENSION", "BITPIX", "PCOUNT", "GCOUNT", "EXTNAME", "END")
    head += [c for c in cards if not c.startswith("NAXIS") and c[:8].strip() not in skip]
    return header_bytes(head) + padded(data.astype(data.dtype.newbyteorder(">")).tobytes())


def label_type(max_label: int, kind: str = "auto") -> str:
    """int16 when the largest label fits, else int32; a forced type that does
    not fit is an error."""
    chosen = kind if kind != "auto" else ("smallint" if max_label <= 32767 else "int")
    if max_label > {"smallint": 32767, "int": 2147483647}[chosen]:
        raise ValueError(f"label {max_label} exceeds {chosen}")
    return chosen


def coadd_cards(n_inputs: int, sigma: float | None, err_mode: str, floor: float, mask_nonfinite: bool,
                allow_nonpositive: bool, output: str) -> list[str]:
    """Provenance of a coadd, for its science plane."""
    out = [
        card("COADDMTH", "WHTMEAN", "weighted mean using WHT"),
        card("COADDWHT", "INVVAR?", "WHT read as inverse variance"),
        card("COADDSIG", "NONE" if sigma is None else f"{sigma:g}", "clip threshold"),
        card("COADDMNF", mask_nonfinite, "non-finite samples excluded"),
        card("COADDNPW", not allow_nonpositive, "WHT<=0 excluded"),
        card("COADDFLR", float(floor), "weight floor"),
        card("COADDOUT", output, "output type"),
        card("COADDERR", err_mode, "ERR construction"),
        note("HISTORY", f"Weighted coadd from {n_inputs} input files"),
        note("HISTORY", "SCI = sum(SCI_i * WHT_i) / sum(WHT_i)"),
    ]
    if sigma is not None:
        out.append(note("HISTORY", f"Sigma clipping applied to SCI stack: sigma={sigma}"))
    return out


def write_image_bands(pixels: DataFrame, folder: str, planes: Sequence[str], width: int, height: int,
                      band_rows: int = 1024, missing: float = float("nan"), cards: Sequence[str] = (),
                      dtype: str = "float32", band_columns: int | None = None) -> DataFrame:
    """Write an image as files of at most band_rows * band_columns pixels, one
    extension per plane; returns (path, y0, rows, x0, columns). Such a block is
    the unit of one task; without ``band_columns`` a block is as wide as the
    image, and an image no taller than ``band_rows`` becomes a single ordinary
    file. Cards that place the image (CRPIX1, CRPIX2) are shifted per block."""
    planes, cards, wide = list(planes), list(cards), band_columns or width

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..sources.fits import card_value

        y0, x0 = int(pdf["_band"].iat[0]) * band_rows, int(pdf["_block"].iat[0]) * wide
        rows, columns = min(band_rows, height - y0), min(wide, width - x0)
        shift = {"CRPIX1": x0, "CRPIX2": y0}
        moved = [card(c[:6], float(card_value(c)) - shift[c[:6]]) if c[:6] in shift and c[6:8] == "  " else c for c in cards]
        place = [card("BANDY0", y0, "first image row of this block"), card("BANDX0", x0, "first image column of this block")]
        body = header_bytes([*PRIMARY, *place])
        for p in planes:
            plane = np.full((rows, columns), missing, dtype)
            ok = pdf[p].notna().to_numpy()
            plane[pdf["y"].to_numpy()[ok] - y0, pdf["x"].to_numpy()[ok] - x0] = pdf[p].to_numpy()[ok]
            body += image_hdu(plane, moved, p.upper())
        fs, where = file_system(folder.rstrip("/"))
        fs.create_dir(where, recursive=True)
        name = f"band-{y0:08d}.fits" if band_columns is None else f"band-{y0:08d}-{x0:08d}.fits"
        draft = f"{where}/_attempt-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(body)
        fs.move(draft, f"{where}/{name}")  # a repeated attempt replaces equal bytes
        return pd.DataFrame({"path": [f"{folder.rstrip('/')}/{name}"], "y0": [y0], "rows": [rows], "x0": [x0], "columns": [columns]})

    keyed = pixels.select("y", "x", *planes).withColumns({
        "_band": F.floor(F.col("y") / F.lit(band_rows)).cast("int"), "_block": F.floor(F.col("x") / F.lit(wide)).cast("int")})
    return keyed.groupBy("_band", "_block").applyInPandas(run, "path string, y0 int, rows int, x0 int, columns int")
