"""Chat formatting with offset-aligned loss masks (operator 4)."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: The marks of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings of common chat templates, escaped inside roles and texts along with the marks.
CONTROLS = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
#: Characters that are rendered and encoded at once; a longer conversation is encoded in runs of whole turns.
WINDOW = 4_000_000
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_READ = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes are doubled and a control string gets one after its first character, so that none is left."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns and the sorted spans of the texts whose role is ``trained``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[list[bool], list[tuple[int, int]]]:
    """Which tokens meet a span, and the parts of the spans that tokens cover, merged where tokens share characters."""
    ends = [b for _, b in offsets]
    starts = [a for a, _ in offsets]
    on, covered = [False] * len(offsets), []
    for a, b in spans:
        piece = None
        for k in range(bisect_right(ends, a), bisect_left(starts, b)):
            lo, hi = max(a, starts[k]), min(b, ends[k])
            if lo < hi:
                on[k] = True
                if piece and lo <= piece[1]:
                    piece[1] = max(piece[1], hi)
                else:
                    covered.append(piece := [lo, hi])
    return on, [(a, b) for a, b in covered]


def tokenizer(path: str):
    """The byte-level tokenizer at ``path`` with the template's marks added as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return t


def format_conversations(rows: DataFrame, path: str, trained: str = "assistant", outputs: bool = False) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens,
    loss_tokens``; with ``outputs``, one row per rendered run: ``conv_id, part, formatted, ids, loss_mask``.

    Conversations are rendered whole, by turn (ties by role, then text, nulls first), and encoded once with offsets;
    sorted spans of the trained turns are intersected with the sorted token spans by binary search. The digests are
    read back from the formatted text and the mask: turns are parsed and unescaped, the loss text is cut by the mask.

    Rows of a conversation are sorted next to each other and read as a stream, so a conversation of any length takes a
    bounded memory: beyond WINDOW characters it is encoded in runs of whole turns, which gives the same tokens because
    marks are tokens of their own. Null text and null role are empty; a null conv_id is a conversation of its own.
    """
    schema = (
        "conv_id long, part int, formatted string, ids array<int>, loss_mask array<boolean>"
        if outputs
        else "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    )

    def run(batches):
        encoder = tokenizer(path)
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())] if outputs else [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        out, state = [], None

        def flush(windows: list[tuple[dict, list]]) -> None:
            rendered = [render(turns, trained) for _, turns in windows]
            for (s, _), (text, spans), coded in zip(windows, rendered, encoder.encode_batch([t for t, _ in rendered], add_special_tokens=False), strict=True):
                on, covered = mask(coded.offsets, spans)
                s["part"] += 1
                if outputs:
                    out.append((s["conv"], s["part"] - 1, text, coded.ids, on))
                    continue
                for role, body in _READ.findall(text):
                    s["turns"] += 1
                    s["all"].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for a, b in covered:
                    part = unescape(text[a:b])
                    s["loss_chars"] += len(part)
                    s["loss"].update(part.encode())
                s["chars"] += len(text)
                s["tokens"] += len(coded.ids)
                s["on"] += sum(on)

        def close(s: dict) -> None:
            if not outputs:
                out.append((s["conv"], s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["tokens"], s["on"]))

        def table() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
            out.clear()
            return batch

        windows: list[tuple[dict, list]] = []
        done: list[dict] = []
        size = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        done.append(state)
                    state = {"conv": conv, "part": 0, "turns": 0, "loss_chars": 0, "chars": 0, "tokens": 0, "on": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                    windows.append((state, []))
                elif not windows:
                    windows.append((state, []))
                windows[-1][1].append((role or "", text or ""))
                size += len(text or "")
                if size >= WINDOW:
                    flush(windows)
                    windows, size = [], 0
                    for s in done:
                        close(s)
                    done = []
                    yield table()
        flush(windows)
        for s in [*done, *([state] if state else [])]:
            close(s)
        if out:
            yield table()

    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*by).select("conv_id", "role", "text").mapInArrow(run, schema)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text")
    return format_conversations(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"))
