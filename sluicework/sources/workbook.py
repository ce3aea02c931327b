"""Workbook sheets: one task per workbook, rows streamed out of the sheet's XML."""

from __future__ import annotations

import datetime
import math
import posixpath
import re
import zipfile
from dataclasses import dataclass
from decimal import Context, Decimal, InvalidOperation
from functools import lru_cache
from itertools import chain
from urllib.parse import unquote
from xml.etree.ElementTree import iterparse
from xml.parsers import expat
from xml.sax.saxutils import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import name_columns, profile
from .files import list_files, open_random, spread
from .text import _stem

BATCH = 5000
# The built-in number formats that show dates or times.
DATE_FORMATS = set(range(14, 23)) | set(range(27, 37)) | set(range(45, 48)) | set(range(50, 59))
EPOCH = datetime.date(1899, 12, 30).toordinal()
LAST_SERIAL = 2958465


@dataclass(frozen=True)
class WorkbookSource:
    path: str
    sheet: str
    suffix: str = ".xlsx"
    header_row: int = 1
    columns: tuple | None = None


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _elements(z: zipfile.ZipFile, name: str, wanted: str):
    with z.open(name) as f:
        for _, e in iterparse(f):
            if _tag(e) == wanted:
                yield e
                e.clear()


def _target(z, wanted: str) -> str | None:
    """The part that holds a sheet: exact name first, else the shortest name it begins."""
    names = {}
    for e in _elements(z, "xl/workbook.xml", "sheet"):
        rid = next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "id"), "")
        names.setdefault(e.attrib["name"], rid)
    starts = sorted((n for n in names if n.startswith(wanted)), key=len)
    pick = wanted if wanted in names else starts[0] if starts else None
    if pick is None:
        return None
    for e in _elements(z, "xl/_rels/workbook.xml.rels", "Relationship"):
        if e.attrib["Id"] == names[pick]:
            t = e.attrib["Target"]
            return t.lstrip("/") if t.startswith("/") else posixpath.normpath("xl/" + t)
    return None


def _texts(z) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in _runs(si)) for si in _elements(z, "xl/sharedStrings.xml", "si")]


def _runs(e):
    for child in e:
        if _tag(child) == "t":
            yield child
        elif _tag(child) == "r":
            yield from (t for t in child if _tag(t) == "t")


def _date_styles(z) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    custom, out = {}, set()
    with z.open("xl/styles.xml") as f:
        for _, e in iterparse(f):
            if _tag(e) == "numFmt":
                custom[int(e.attrib["numFmtId"])] = e.attrib.get("formatCode", "")
            elif _tag(e) == "cellXfs":
                for i, xf in enumerate(e):
                    fid = int(xf.attrib.get("numFmtId", 0))
                    if fid in DATE_FORMATS or _is_date_code(custom.get(fid, "")):
                        out.add(i)
    return out


def _is_date_code(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and "General" not in code


def serial_text(serial: float) -> str | None:
    """``YYYY-MM-DD hh:mm:ss`` of a date serial; None outside the calendar."""
    if not math.isfinite(serial) or not 0 <= serial <= LAST_SERIAL:
        return None
    day = math.floor(serial)
    minutes, seconds = divmod(math.floor((serial - day) * 86400.0), 60)
    return f"{datetime.date.fromordinal(EPOCH + day)} {minutes // 60:02d}:{minutes % 60:02d}:{seconds:02d}"


def number_text(raw: str) -> str:
    """A stored number without exponent or idle zeros."""
    if "e" in raw or "E" in raw:
        try:
            d = Decimal(raw).quantize(Decimal("1e-12"), context=Context(prec=60))
        except InvalidOperation:
            return raw
        raw = f"{d:f}"
    return raw.rstrip("0").rstrip(".") if "." in raw else raw


def cell_text(raw: str, kind: str, style: int, texts: list[str], dates: set[int]) -> str:
    if kind == "s":
        return texts[int(raw)] if raw.isdigit() and int(raw) < len(texts) else ""
    if kind in ("inlineStr", "str"):
        return raw
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind == "e" or raw == "":
        return ""
    if style in dates:
        try:
            return serial_text(float(raw)) or raw
        except ValueError:
            return raw
    return number_text(raw)


MAX_COLUMNS = 16_384  # of the file format


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    if n > MAX_COLUMNS:
        raise ValueError(f"cell {ref!r} lies beyond the last column of a sheet")
    return max(n - 1, 0)


class _Inside(dict):
    """What an element's children are: by tag, which is looked at once for its local name."""

    def __init__(self, **known):
        self.known, self.other = known, None

    def __missing__(self, tag):
        self[tag] = found = self.known.get(tag.rsplit("}", 1)[-1], self if self.other is None else self.other)
        return found


# The elements of a sheet that hold something; rows may lie at any depth.
_OTHER, _VALUE, _TEXT = _Inside(), _Inside(), _Inside()
_RUN = _Inside(t=_TEXT)
_INLINE = _Inside(t=_TEXT, r=_RUN)
_CELL = _Inside(v=_VALUE, **{"is": _INLINE})
_ROW = _Inside(c=_CELL)
_SHEET = _Inside(row=_ROW)
for _e in (_VALUE, _TEXT, _RUN, _INLINE, _CELL, _ROW):
    _e.other = _OTHER
FIRST_BLOCK, BLOCK = 1 << 13, 1 << 17
_DIGITS = "0123456789"
# Rows as nearly every writer spells them. A block that is nothing but such rows is cut here, any other one is parsed.
_BARE = r"[^<&\x00-\x08\x0b-\x1f]*"
_TEXT_OF = rf"({_BARE}(?:&(?:amp|lt|gt|quot|apos);{_BARE})*)"
_ATTRIBUTES = r'((?: [A-Za-z:]+="[^"<>&\s]*")*)'
_PLAIN = re.compile(
    rf'<c r="([A-Z]+)[0-9]*"{_ATTRIBUTES}(?:/>|>(?:<v>{_TEXT_OF}</v>|<is><t(?: xml:space="preserve")?>{_TEXT_OF}</t></is>)</c>)|</row><row r="([0-9]+)"{_ATTRIBUTES}>'
)
_FIRST, _END = re.compile(rb"<row[ >]"), b"</row>"
_UTF8 = re.compile(
    rb"\A(\xef\xbb\xbf)?<\?xml version=[\"']1\.0[\"']( encoding=[\"'](?i:utf-8)[\"'])?( standalone=[\"'](yes|no)[\"'])?\s*\?>"
)


def _blocks(f):
    """The bytes of a sheet, cut before its first row and behind rows; no block ends between ``<`` and what follows it."""
    rest, size, begun = b"", FIRST_BLOCK, False
    while more := f.read(size):
        rest, size = rest + more, min(2 * size, BLOCK)
        if not begun:
            first = _FIRST.search(rest)
            begun = first is not None
            cut = first.start() if begun else max(rest.rfind(b"<"), 0)
            yield rest[:cut]
            rest = rest[cut:]
        if begun and _END in rest:
            cut = rest.rindex(_END) + len(_END)
            yield rest[:cut]
            rest = rest[cut:]
    yield rest


def _kind(attributes: str) -> tuple[str, int]:
    found = dict(re.findall(r'([A-Za-z:]+)="([^"]*)"', attributes))
    return found.get("t", ""), int(found.get("s", 0))


def _plain_rows(block: bytes, column, kind_of, texts: list[str], dates: set[int]):
    """The rows of a block of whole rows; None unless all of them are plain ones."""
    try:
        parts = _PLAIN.split("</row>" + block[: -len(_END)].decode())
    except UnicodeDecodeError:
        return None
    if any(parts[::7]) or b"]]>" in block or parts[5] is None:
        return None
    out, cells = [], []
    for letters, attributes, value, inline, number in zip(parts[1::7], parts[2::7], parts[3::7], parts[4::7], parts[5::7]):
        if number is not None:
            cells = []
            out.append((int(number), cells))
            continue
        at, (kind, style) = column(letters), kind_of(attributes)
        if at > len(cells):
            cells.extend([""] * (at - len(cells)))
        raw = value or inline or ""
        if "&" in raw:
            raw = unescape(raw, {"&quot;": '"', "&apos;": "'"})
        cells.append(cell_text(raw, kind, style, texts, dates))
    return out


def sheet_rows(z: zipfile.ZipFile, part: str):
    """(row number, cells) of a sheet, in order. Nothing of the sheet is kept but the rows of one block."""
    texts, dates = _texts(z), _date_styles(z)
    column, kind_of = lru_cache(MAX_COLUMNS)(_column), lru_cache(10_000)(_kind)
    here, above, done, number = _SHEET, [], [], 0
    cells: list[str] = []
    at, kind, style, raw = 0, "", 0, ""

    def start(tag, attrs):
        nonlocal here, number, cells, at, kind, style, raw
        inner = here[tag]
        if inner is _CELL:
            ref = attrs.get("r")
            at = len(cells) if ref is None else column(ref.rstrip(_DIGITS))
            kind, style, raw = attrs.get("t", ""), int(attrs.get("s", 0)), ""
        elif inner is _VALUE or inner is _INLINE:
            raw = ""
        elif inner is _ROW:
            number, cells = int(attrs.get("r", number + 1)), []
        elif here is _VALUE or here is _TEXT:
            here = _OTHER  # what follows a child is not the element's own text
        above.append(here)
        here = inner

    def end(tag):
        nonlocal here
        if here is _CELL:
            if at > len(cells):
                cells.extend([""] * (at - len(cells)))
            cells.append(cell_text(raw, kind, style, texts, dates))
        elif here is _ROW:
            done.append((number, cells))
        here = above.pop()

    def data(text):
        nonlocal raw
        if here is _VALUE or here is _TEXT:
            raw += text

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    # Blocks are cut as long as no markup was met that may hold rows as text: comments, CDATA, instructions.
    bare = True
    with z.open(part) as f:
        for block in _blocks(f):
            cut = bare and above and here is _SHEET and block.endswith(_END)
            rows = _plain_rows(block, column, kind_of, texts, dates) if cut else None
            if rows is None:
                bare = bare and b"<!" not in block and b"<?" not in _UTF8.sub(b"", block)
                parser.Parse(block, False)
                yield from done
                done.clear()
            else:
                number = rows[-1][0]
                yield from rows
    parser.Parse(b"", True)
    yield from done


_HEAD = pa.schema([("_path", pa.string()), ("_header", pa.list_(pa.string()))])
_CELLS = pa.schema([("_path", pa.string()), ("_file", pa.string()), ("_record_num", pa.int64()), ("_fields", pa.list_(pa.string()))])


def _head(path: str, cells: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([path], pa.string()), pa.array([cells], pa.list_(pa.string()))], schema=_HEAD)


def _cells(path: str, name: str, first: int, rows: list[list[str]], width: int) -> pa.RecordBatch:
    n = len(rows)
    starts = pa.array(range(0, n * width + 1, width), pa.int32())
    fields = pa.ListArray.from_arrays(starts, pa.array(list(chain.from_iterable(rows)), pa.string()))
    return pa.record_batch([pa.repeat(path, n), pa.repeat(name, n), pa.array(range(first, first + n), pa.int64()), fields], schema=_CELLS)


def _parts(src: WorkbookSource, header_only: bool):
    sheet, at = src.sheet, src.header_row

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = unquote(path.rsplit("/", 1)[-1])
                with open_random(path) as f, zipfile.ZipFile(f) as z:
                    part = _target(z, sheet)
                    if part is None:
                        continue
                    skip, width, n, out = 0, 0, 0, []
                    for number, cells in sheet_rows(z, part):
                        if number < at:
                            continue
                        if number == at:
                            skip = next((i for i, c in enumerate(cells) if c.strip()), len(cells))
                            width = len(cells) - skip
                            if header_only:
                                yield _head(path, [c.strip(" ") for c in cells[skip:]])
                                break
                            continue
                        if width == 0:
                            if any(cells):
                                raise ValueError(f"{name}: the header row {at} is blank but data follows")
                            continue
                        row = cells[skip : skip + width]
                        if len(row) < width:
                            row += [""] * (width - len(row))
                        out.append(row)
                        if len(out) == BATCH:
                            yield _cells(path, name, n + 1, out, width)
                            n, out = n + BATCH, []
                    if out:
                        yield _cells(path, name, n + 1, out, width)

    return read


def scan(spark: SparkSession, src: WorkbookSource) -> DataFrame:
    """The named sheet of every workbook as one table; a workbook without it gives no rows."""
    files = spread(list_files(spark, src.path, src.suffix).select("path"), spark)
    heads = files.mapInArrow(_parts(src, True), "_path string, _header array<string>")
    rows = files.mapInArrow(
        _parts(src, False), "_path string, _file string, _record_num long, _fields array<string>"
    ).withColumns({"_stem": _stem(F.col("_file"), src.suffix), "_sheet": F.lit(src.sheet)})
    return name_columns(rows, heads, profile(heads), src.columns).drop("_path")
