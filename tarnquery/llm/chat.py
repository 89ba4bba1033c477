"""Chat formatting: records of differing layouts become canonical turns, and turns a templated text with a loss mask.

A record's schema fingerprint is a hash of its nested field paths; it selects a declarative mapping that says where the
turns are and which fields hold role and text. A fingerprint is resolved once, to the mapping that needs the most of its
paths; other fields are ignored. Records of a layout without a mapping are kept aside, never guessed at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Template of a turn. These strings are fixed values of the format.
START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. paths: what a record must have. each: path of a list of turns; else fixed gives
    (role, path) in order. A path is also there if something is nested below it, as in texts given as lists of parts."""

    name: str
    paths: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: Roles of other layouts as canonical ones.
ROLES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("turn", ("role", "text"), role="role", text="text"),
    Mapping("turn_content", ("role", "content"), role="role", text="content"),
    Mapping("messages", ("messages[].role", "messages[].content"), each="messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=ROLES),
    Mapping("prompt_response", ("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction_output", ("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input_output", ("instruction", "input", "output"), fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question_answer", ("question", "answer"), fixed=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(value, at: str = "") -> Iterator[str]:
    """Paths of all leaves; items of lists share the path of their list with []. Empty lists and objects are leaves."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from field_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from field_paths(v, f"{at}[]")
        if not value:
            yield f"{at}[]"
    else:
        yield at


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def resolve(paths: set[str], mappings: tuple[Mapping, ...]) -> Mapping | None:
    """The mapping that needs the most of these paths, of several the first. An empty list of turns fits its mapping."""

    def there(path: str) -> bool:
        return any(p == path or p.startswith((f"{path}.", f"{path}[")) for p in paths)

    fits = [m for m in mappings if all(map(there, m.paths)) or (m.each and f"{m.each}[]" in paths)]
    return max(fits, key=lambda m: len(m.paths), default=None)


def _turns(batches, mappings: tuple[Mapping, ...]):
    """Rows (…, record) become (…, layout, turn_no, role, text); a record without turns gives one row without a turn."""
    layouts: dict[str, Mapping | None] = {}
    for batch in batches:
        keep = batch.num_columns - 1
        at, out = [], ([], [], [], [])
        for i, raw in enumerate(batch.column(keep).to_pylist()):
            try:
                record = json.loads(raw) if raw is not None else None
            except ValueError:
                record = None
            m = None
            if isinstance(record, dict):
                paths = set(field_paths(record))
                layout = fingerprint(paths)
                if layout not in layouts:
                    layouts[layout] = resolve(paths, mappings)
                m = layouts[layout]
            rows = list(_apply(m, record)) if m else []
            for turn in rows or [(None, None, None)]:
                at.append(i)
                for column, v in zip(out, (m and m.name, *turn), strict=True):
                    column.append(v)
        types = (pa.string(), pa.int64(), pa.string(), pa.string())
        columns = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(keep)]
        columns += [pa.array(c, t) for c, t in zip(out, types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:keep], "layout", "turn_no", "role", "text"])


def _plain(value) -> str:
    """A text; of a list of parts the texts of the parts one after another, and other values as JSON."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        return "".join(_plain(v.get("text", v) if isinstance(v, dict) else v) for v in value)
    return json.dumps(value, ensure_ascii=False)


def _apply(m: Mapping, record: dict):
    roles = dict(m.roles)
    if m.fixed:
        found = [(role, _plain(record[path])) for role, path in m.fixed]
        found = [x for k, x in enumerate(found) if x[1] or k in (0, len(found) - 1)]
    else:
        turns = record[m.each] if m.each else [record]
        found = [(_plain(t.get(m.role)), _plain(t.get(m.text))) for t in turns if isinstance(t, dict)]
    for k, (role, text) in enumerate(found):
        yield k, roles.get(role, role), text


def canonical_turns(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The other columns of records with layout, turn_no, role and text: one row for each turn of each JSON record.

    A record that is null, isn't JSON, has an unknown layout or no turns yields one row without a turn, so nothing is
    lost. Null texts count as empty; equal records each give their turns; columns with the names of the result are
    dropped from the input first.
    """
    rest = [c for c in records.columns if c not in (record_col, "layout", "turn_no", "role", "text")]
    slim = records.select(*rest, record_col)
    schema = slim.drop(record_col).schema.add("layout", "string").add("turn_no", "long").add("role", "string").add("text", "string")
    return slim.mapInArrow(partial(_turns, mappings=mappings), schema)


def escape(text: str) -> str:
    """No control string is left: each "<" run before "|" gets one more backslash. unescape undoes it."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the span of its text in it."""
    head = f"{START}{escape(role).replace(chr(10), '<|n|>')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    head, _, body = formatted.partition("\n")
    return unescape(head.removeprefix(START).replace("<|n|>", "\n")), unescape(body.removesuffix(f"{END}\n"))


def _formatted(batches):
    for batch in batches:
        keep = batch.num_columns - 2
        rows = [format_turn(r or "", t or "") for r, t in zip(batch.column(keep).to_pylist(), batch.column(keep + 1).to_pylist(), strict=True)]
        loss = [r == "assistant" for r in batch.column(keep).to_pylist()]
        columns = [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] if m else 0 for x, m in zip(rows, loss, strict=True)], pa.int64()), pa.array([x[2] if m else 0 for x, m in zip(rows, loss, strict=True)], pa.int64())]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(keep)], *columns], [*batch.schema.names[:keep], "formatted", "loss_start", "loss_end"])


def format_chat(turns: DataFrame) -> DataFrame:
    """Canonical turns with `formatted` and the span of it that the loss counts (empty but for assistants' texts).

    A conversation's text is its formatted turns one after another. Null roles and texts count as empty. Turns stay
    rows, so a conversation of any length is never one value.
    """
    rest = [c for c in turns.columns if c not in ("role", "text", "formatted", "loss_start", "loss_end")]
    schema = turns.select(rest).schema.add("formatted", "string").add("loss_start", "long").add("loss_end", "long")
    return turns.select(*rest, "role", "text").mapInArrow(_formatted, schema)


def _digests(batches):
    """Streams the sorted formatted turns of a partition; only the running digests of one conversation are held."""
    now, row = None, None

    def end():
        return {"conv_id": [now], "n_turns": [row[0]], "turns_sha256": [row[1].hexdigest()], "loss_chars": [row[2]], "loss_sha256": [row[3].hexdigest()], "formatted_chars": [row[4]]}

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        out = {name: [] for name in schema.names}
        for conv, text, a, b in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 3)], strict=True):
            if row is None or conv != now:
                if row is not None:
                    for k, v in end().items():
                        out[k] += v
                now, row = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, said = parse_turn(text)
            loss = unescape(text[a:b])
            row[0] += 1
            row[1].update(f"{role}\n{said}\n".encode())
            row[2] += len(loss)
            row[3].update(loss.encode())
            row[4] += len(text)
        yield pa.RecordBatch.from_pydict(out, schema=schema)
    if row is not None:
        yield pa.RecordBatch.from_pydict(end(), schema=schema)


def conversation_digests(formatted: DataFrame, order: list[str]) -> DataFrame:
    """Per conv_id what can be read back from the formatted turns: their number, digests of turns and of the loss text.

    Turns that are equal in `order` are taken in any order, so it should end in the formatted text. A null conv_id is a
    conversation of its own. A partition is streamed, so neither a long conversation nor a long text is held twice.
    """
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_digests, schema)


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows of one turn each as JSON records, with conv_id and turn.

    A hash of the row deals them to three layouts: role and text, role and content, and a list of one message. Null
    roles and texts are written as empty; other columns are dropped.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    message = F.struct(role.alias("role"), text.alias("content"))
    layout = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    record = F.when(layout == 0, F.to_json(F.struct(role.alias("role"), text.alias("text"))))
    record = record.when(layout == 1, F.to_json(message)).otherwise(F.to_json(F.struct(F.array(message).alias("messages"))))
    return conversations.select("conv_id", "turn", record.alias("record"))
