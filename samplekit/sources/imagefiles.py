"""Labelled image files as a Spark data source: format "labelled_images", which reads and writes <class>_<split>/<name>.<extension>.

Files are listed once, by the directories that the filters on label and split leave, and dealt out to partitions of about equally many
bytes. PGM, PPM, BMP and PNG files are decoded without a codec, by what their bytes say and not by their name; a file that can't be decoded gives a row
with the reason. Any store that Arrow opens by its address can be read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Extensions that are read here, classes with their labels, splits, and what files of a format begin with.
EXTENSIONS = ("png", "bmp", "pgm", "ppm")
CLASSES = {"attack": 1, "bonafide": 0}
SPLITS = ("training", "validation")
MAGIC = {"pgm": (b"P2", b"P5"), "ppm": (b"P3", b"P6"), "bmp": (b"BM",), "png": (b"\x89PNG\r\n\x1a\n",), "jpeg": (b"\xff\xd8\xff",), "tiff": (b"II*\0", b"MM\0*")}
PART_BYTES, FILE_BYTES = 64 << 20, 1 << 20  # of a partition; what opening a file counts as at least a sixteenth of
SCHEMA = "path string, label int, split string, height int, width int, channels int, pixels binary, reason string"


class Undecodable(ValueError):
    """An image that can't be decoded, with the reason."""


def _text_header(body: bytes, count: int) -> tuple[list[int], int]:
    """Numbers of a portable map's header behind its two letters, without comments, and where they end."""
    found, at = [], 2
    while len(found) < count:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)").match(body, at)
        if m is None:
            raise Undecodable("broken header")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def _portable_map(body: bytes) -> np.ndarray:
    (width, height, most), at = _text_header(body, 3)
    channels = 3 if body[1:2] in b"36" else 1
    size = width * height * channels
    if not size or not 0 < most < 65536:
        raise Undecodable("zero size" if not size else "broken header")
    if body[1:2] in b"23":
        values = np.array(re.sub(rb"#[^\n]*", b"", body[at:]).split()[:size], dtype=np.int64)
    else:
        values = np.frombuffer(body[at + 1 :], ">u2" if most > 255 else np.uint8)[:size]
    if len(values) < size:
        raise Undecodable("cut off")
    scaled = values if most == 255 else np.rint(values * (255 / most))
    return np.clip(scaled, 0, 255).astype(np.uint8).reshape(height, width, channels)


def _bitmap(body: bytes) -> np.ndarray:
    if len(body) < 54:
        raise Undecodable("cut off")
    number = lambda at, size=4, signed=False: int.from_bytes(body[at : at + size], "little", signed=signed)
    start, head, width, height, bits, packed = number(10), number(14), number(18, signed=True), number(22, signed=True), number(28, 2), number(30)
    if width <= 0 or height == 0:
        raise Undecodable("zero size")
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise Undecodable("unknown kind of bitmap")
    stride = (width * bits + 31) // 32 * 4
    if len(body) < start + stride * abs(height):
        raise Undecodable("cut off")
    rows = np.frombuffer(body, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits > 8:
        return rows.reshape(abs(height), width, bits // 8)[..., 2::-1]  # stored as blue, green, red
    colours = number(46) or 256
    palette = np.zeros((256, 3), np.uint8)
    stored = np.frombuffer(body, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    palette[: len(stored)] = stored
    return palette[rows]


def _png(body: bytes) -> np.ndarray:
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(body):
        size, kind = int.from_bytes(body[at : at + 4], "big"), body[at + 4 : at + 8]
        part = body[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = part
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(part)
        at += size + 12
    if head is None or len(head) < 13:
        raise Undecodable("broken header")
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[9])
    if not width or not height:
        raise Undecodable("zero size")
    if channels is None or head[8] != 8 or head[12]:
        raise Undecodable("unknown kind of png")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as error:
        raise Undecodable("cut off") from error
    stride = width * channels
    if len(raw) < height * (stride + 1):
        raise Undecodable("cut off")
    lines = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height + 1, width + 1, channels), np.int32)  # a row above and a pixel before, of zeros
    for y in range(height):
        row = lines[y, 1:].reshape(width, channels).astype(np.int32)
        up, kind = out[y, 1:], int(lines[y, 0])
        if kind == 0:
            out[y + 1, 1:] = row
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(row, 0) & 255
        elif kind == 2:
            out[y + 1, 1:] = row + up & 255
        elif kind in (3, 4):
            for x in range(width):
                left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    a, b, c = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
                out[y + 1, x + 1] = row[x] + guess & 255
        else:
            raise Undecodable("broken data")
    image = out[1:, 1:].astype(np.uint8)
    if head[9] == 3:
        if palette is None or int(image.max()) >= len(palette):
            raise Undecodable("broken data")
        return palette[image[..., 0]]
    return image[..., :1] if channels == 2 else image[..., :3]


def decoded(body: bytes) -> np.ndarray:
    """height x width x 3 bytes, in the order blue, green, red; a gray image has three equal channels. An error, with the reason, where it can't be decoded."""
    if not body:
        raise Undecodable("empty file")
    kind = next((k for k, marks in MAGIC.items() if body.startswith(marks)), None)
    if kind is None:
        raise Undecodable("no known format")
    if kind in ("jpeg", "tiff"):
        raise Undecodable(f"{kind} under another format's extension")
    image = {"pgm": _portable_map, "ppm": _portable_map, "bmp": _bitmap, "png": _png}[kind](body)
    return np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[..., ::-1]


def encoded(height: int, width: int, channels: int, pixels: bytes) -> tuple[str, bytes]:
    """Extension and bytes: gray images as PGM, others, of blue, green and red, as BMP."""
    if channels == 1:
        return "pgm", b"P5\n%d %d\n255\n" % (width, height) + pixels
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = np.frombuffer(pixels, np.uint8).reshape(height, width * 3)
    number = lambda *values: b"".join(v.to_bytes(4, "little", signed=True) for v in values)
    head = b"BM" + number(54 + stride * height, 0, 54, 40, width, -height) + b"\1\0\x18\0" + number(0, stride * height, 0, 0, 0, 0)
    return "bmp", head + rows.tobytes()


def _store(path: str):  # noqa: ANN202
    """Arrow's file system of an address, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[6:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Paths of one task, with label and split."""

    files: list[tuple[str, int, str]] = field(default_factory=list)

    def __init__(self, files: list[tuple[str, int, str]]) -> None:
        super().__init__(files)
        self.files = files


class ImageReader(DataSourceReader):
    def __init__(self, base: str, part_bytes: int) -> None:
        self.base, self.part_bytes = base, part_bytes
        self.labels, self.splits = set(CLASSES.values()), set(SPLITS)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters that name labels or splits decide which directories are listed; all others go back to Spark."""
        own = {("label",): "labels", ("split",): "splits"}
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and tuple(f.attribute) in own:
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                name = own[tuple(f.attribute)]
                setattr(self, name, getattr(self, name) & wanted)
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, base = _store(self.base)
        scheme = self.base[: len(self.base) - len(base)] if self.base.endswith(base) else "file:" if self.base.startswith("file:") else ""
        out, size = [Files([])], 0
        for kind, label in CLASSES.items():
            for split in SPLITS:
                if label not in self.labels or split not in self.splits:
                    continue
                found = store.get_file_info(fs.FileSelector(f"{base}/{kind}_{split}", allow_not_found=True))
                for info in sorted(found, key=lambda i: i.path):
                    if info.type == fs.FileType.File and info.extension in (*EXTENSIONS, *(e.upper() for e in EXTENSIONS)):
                        out[-1].files.append((f"{scheme}{info.path}", label, split))
                        size += max(info.size or 0, FILE_BYTES // 16)
                        if size >= self.part_bytes:
                            out.append(Files([]))
                            size = 0
        return out if out[-1].files or len(out) == 1 else out[:-1]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, label, split in partition.files:
            store, place = _store(path)
            try:
                with store.open_input_stream(place) as stream:
                    image = decoded(stream.read())
                yield path, label, split, image.shape[0], image.shape[1], 3, image.tobytes(), None
            except Undecodable as why:
                yield path, label, split, None, None, None, None, str(why)
            except OSError:
                yield path, label, split, None, None, None, None, "not readable"


@dataclass
class Written(WriterCommitMessage):
    count: int


class ImageWriter(DataSourceWriter):
    """Rows (name, label, split, height, width, channels, pixels) as files; a task that runs again writes the same names again."""

    def __init__(self, base: str) -> None:
        self.base = base

    def write(self, iterator: Iterator) -> Written:  # noqa: A003
        names, count = {v: k for k, v in CLASSES.items()}, 0
        store, base = _store(self.base)
        made: set[str] = set()
        for row in iterator:
            folder = f"{base}/{names[row.label]}_{row.split}"
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            extension, body = encoded(row.height, row.width, row.channels, bytes(row.pixels))
            with store.open_output_stream(f"{folder}/{row.name}.{extension}") as out:
                out.write(body)
            count += 1
        return Written(count)


class LabelledImages(DataSource):
    """Options: path, the folder of the four directories; partBytes, bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "labelled_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(self.options["path"].rstrip("/"), int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"].rstrip("/"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LabelledImages)
