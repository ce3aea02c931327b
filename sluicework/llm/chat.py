"""Chat formatting: typed content parts flattened by a visitor, one string and a loss mask for each conversation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil, inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A turn is TURN, role, SAYS, content, END. Placeholders of attachments are `<|image|>`, `<|audio|>`, `<|document|>`.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings, own and common ones, that a text must not be able to spell: first character and rest.
_CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\])")
_TURNS = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(SAYS) + r"(.*?)" + re.escape(END), re.S)

#: Tokens a placeholder stands for: image patches of so many pixels, audio tokens a second, tokens a page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024

PART = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kind", "text", "ref")] + [T.StructField(n, T.DoubleType()) for n in ("width", "height", "seconds", "pages")]
)
PARTS = T.ArrayType(PART)


def escape(text: str) -> str:
    """One backslash more behind the first character of every control string, however many stand there already."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def units(size: float | None, each: float = 1) -> int:
    """Size in started units; missing, negative, endless and undefined sizes are 0."""
    return ceil(size / each) if size is not None and 0 < size < inf else 0


class Flatten:
    """Visits the parts of one turn in order. Texts that stand side by side are joined before they are escaped, so that
    no control string forms across them; attachments keep their places in the content."""

    def __init__(self):
        self.content, self.text, self.length = [], [], 0
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, max(1, units(part["width"], IMAGE_PATCH) * units(part["height"], IMAGE_PATCH)))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, units(part["seconds"], 1 / AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, units(part["pages"])) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        """A kind without a placeholder is read as its text."""
        self.visit_text(part)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.flush()
        self.attachments.append({"kind": kind, "ref": part["ref"], "tokens": tokens, "place": self.length})
        self.add(f"<|{kind}|>")

    def flush(self) -> None:
        self.add(escape("".join(self.text)))
        self.text = []

    def add(self, content: str) -> None:
        self.content.append(content)
        self.length += len(content)


def format_turns(turns: list[dict]) -> tuple[str, list[dict], list[dict]]:
    """Formatted string, loss spans (code points of assistant contents), attachments with their places."""
    out, at, loss, attached = [], 0, [], []
    for number, turn in enumerate(turns):
        visitor = Flatten()
        head = TURN + escape(turn["role"] or "") + SAYS
        for part in turn["parts"] or []:
            visitor.visit(part)
        visitor.flush()
        start = at + len(head)
        if turn["role"] == "assistant":
            loss.append({"start": start, "end": start + visitor.length})
        attached += [{**found, "turn": number, "place": start + found["place"]} for found in visitor.attachments]
        out += [head, *visitor.content, END]
        at = start + visitor.length + len(END)
    return "".join(out), loss, attached


_PAIR = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ATTACHED = T.ArrayType(
    T.StructType([T.StructField("turn", T.LongType()), T.StructField("place", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType())])
)


def text_part(text) -> F.Column:
    """A text column as the only part of a turn."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), *[F.lit(None).cast("double").alias(n) for n in ("width", "height", "seconds", "pages")]))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: id, formatted, n_turns, loss (spans in code points), attachments.

    parts_col is an array of PART: a text part is written out, an image, audio
    or document part becomes a placeholder in its place, with its reference and
    the number of tokens it expands to in attachments. Control strings inside
    texts and roles get a backslash, which `unescape` takes off again.

    Turns stand in the order of their number (nulls first), equal numbers in the
    order of role and content. Null parts and null texts are empty, a part of an
    unknown kind is its text, undefined and negative sizes count as none; a null
    role is the empty role. Rows with a null id are one conversation. The turns of a
    conversation meet in one task, as its one string must; nothing else does.
    """
    schema = T.StructType(
        [T.StructField(id_col, turns.schema[id_col].dataType), T.StructField("formatted", T.StringType()), T.StructField("n_turns", T.LongType()), T.StructField("loss", _PAIR), T.StructField("attachments", _ATTACHED)]
    )
    arrow = to_arrow_schema(schema)
    parts = F.col(parts_col).cast(PARTS)
    each = turns.select(F.col(id_col), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), parts.alias("parts")).alias("t"))
    gathered = each.groupBy(id_col).agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns(batch.column(1)[i].as_py()) + (len(batch.column(1)[i]),) for i in range(batch.num_rows)]
            columns = [[m[k] for m in made] for k in (0, 3, 1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]], schema=arrow)

    return gathered.mapInArrow(run, schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back."""
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted strings and loss masks say: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = T.StructType(
        [T.StructField(id_col, formatted.schema[id_col].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in batch.column(2)[i].as_py())
                every = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

    return formatted.select(id_col, "formatted", "loss").mapInArrow(run, schema)
