"""Chat formatting by schema fingerprints.

A record is a JSON text of any layout. The set of its nested field paths is hashed; the hash selects a
declarative mapping that says where turns, roles and texts are. Turns become canonical (role, text) rows, and
each is rendered as a segment of a template that marks turns; a conversation is its segments in order.
Control strings inside roles and texts are escaped by a backslash after their first character (one more
where some are there already), so reading back is exact and no text can forge a turn. The loss mask is
given as the span of the assistant's text in each segment.

Scale. Rendering works turn by turn; digests stream over turns sorted inside partitions and hold one turn at
a time, so a long conversation needs no more memory than its longest turn.

Defined results. Null text: empty. Null role: empty role. Equal turn numbers: ordered by role, then text.
Repeated rows: turns each. A layout without mapping: no turns, and it is listed by ``unmapped`` with its fingerprint; a record that is no JSON object,
is nested too deeply to be read, or holds half a surrogate pair (no Unicode text): likewise, with an empty fingerprint. Very long texts: whole.
Empty table: no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "instructor": "system"}

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")
_SEGMENT = re.compile(r"<\|im_start\|>((?:[^\n\\]|\\.)*)\n(.*)<\|im_end\|>\n", re.S)

#: Declarative mappings: field paths of the layout, and where turns are. ``each``: a list of messages;
#: otherwise fields that become one turn each. Optional paths may be absent.
MAPPINGS = [
    {"name": "turn row", "paths": ["role", "text"], "optional": ["turn"], "turns": [{"role_at": "role", "text_at": ["text"]}]},
    {"name": "messages", "paths": ["messages[].content", "messages[].role"], "each": "messages", "role_at": "role", "text_at": "content"},
    {"name": "shared chats", "paths": ["conversations[].from", "conversations[].value"], "each": "conversations", "role_at": "from", "text_at": "value"},
    {"name": "turns", "paths": ["turns[].role", "turns[].text"], "each": "turns", "role_at": "role", "text_at": "text"},
    {"name": "prompt and completion", "paths": ["prompt", "completion"], "optional": ["system"], "turns": [{"role": "system", "text_at": ["system"]}, {"role": "user", "text_at": ["prompt"]}, {"role": "assistant", "text_at": ["completion"]}]},
    {"name": "prompt and response", "paths": ["prompt", "response"], "optional": ["system"], "turns": [{"role": "system", "text_at": ["system"]}, {"role": "user", "text_at": ["prompt"]}, {"role": "assistant", "text_at": ["response"]}]},
    {"name": "instruction", "paths": ["instruction", "output"], "optional": ["input", "system"], "turns": [{"role": "system", "text_at": ["system"]}, {"role": "user", "text_at": ["instruction", "input"]}, {"role": "assistant", "text_at": ["output"]}]},
    {"name": "question and answer", "paths": ["question", "answer"], "optional": ["context"], "turns": [{"role": "user", "text_at": ["context", "question"]}, {"role": "assistant", "text_at": ["answer"]}]},
]


def paths(value) -> set[str]:
    """Nested field paths; list elements are ``[]``. Dots, brackets and backslashes inside names are escaped."""
    out, todo = set(), [("", value)]
    while todo:
        prefix, v = todo.pop()
        if isinstance(v, dict) and v:
            todo += [(f"{prefix}.{name}" if prefix else name, x) for k, x in v.items() for name in [re.sub(r"([.\[\]\\])", r"\\\1", k) or "\\"]]
        elif isinstance(v, list):
            todo += [(f"{prefix}[]", x) for x in v]
            out |= set() if v else {f"{prefix}[]"}
        else:
            out.add(prefix)
    return out


def fingerprint(of: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(of)).encode()).hexdigest()[:16]


def _known() -> dict[str, dict]:
    out = {}
    for m in MAPPINGS:
        extra = m.get("optional", [])
        for bits in range(1 << len(extra)):
            out[fingerprint({*m["paths"], *(x for k, x in enumerate(extra) if bits >> k & 1)})] = m
    return out


KNOWN = _known()


def canonical(record: str | None) -> tuple[str, list[tuple[str, str]] | None]:
    """Fingerprint and turns of a record; None where no mapping fits."""
    try:
        value = json.loads(record) if record else None
        if not isinstance(value, dict):
            return "", None
        mark = fingerprint(paths(value))
        if _SURROGATE.search(record):
            json.dumps(value, ensure_ascii=False).encode()  # fails on half a pair
    except (ValueError, RecursionError):
        return "", None
    if (m := KNOWN.get(mark)) is None:
        return mark, None
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    role = lambda x: ROLES.get(text(x).lower(), text(x))
    if "each" in m:
        return mark, [(role(x.get(m["role_at"])), text(x.get(m["text_at"]))) for x in value[m["each"]]]
    out = []
    for t in m["turns"]:
        given = [text(value[k]) for k in t["text_at"] if value.get(k) is not None]
        if given or "role_at" in t:
            out.append((role(value.get(t["role_at"])) if "role_at" in t else t["role"], "\n\n".join(x for x in given if x)))
    return mark, out


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A segment, and the span of its loss mask in code points (empty but for the assistant)."""
    head = f"{OPEN}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
    body = escape(text)
    begin = len(head)
    return head + body + CLOSE, begin, begin + (len(body) if role == "assistant" else 0)


def read_back(segment: str) -> tuple[str, str]:
    m = _SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError("not one rendered turn")
    role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1]))
    return role, unescape(m[2])


def canonical_turns(records: DataFrame, id_column: str, record_column: str, order: str | None = None) -> DataFrame:
    """id, at (order of the record, then of the turn in it), role, text, fingerprint, segment, loss_start, loss_end."""
    at = F.col(order).cast("long") if order else F.lit(0).cast("long")

    def convert(batches):
        for batch in batches:
            ids, ats, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, a, record in zip(ids, ats, batch.column(2).to_pylist()):
                mark, turns = canonical(record)
                for k, (role, text) in enumerate(turns or []):
                    out.append((i, a, k, role, text, mark, *render(role, text)))
            columns = list(zip(*out)) if out else [[] for _ in range(9)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "record_at", "turn_at", "role", "text", "fingerprint", "segment", "loss_start", "loss_end"])

    source = records.select(F.col(id_column).cast("long").alias("id"), at.alias("at"), F.col(record_column).cast("string").alias("record"))
    return source.mapInArrow(convert, "id long, record_at long, turn_at int, role string, text string, fingerprint string, segment string, loss_start long, loss_end long")


def unmapped(records: DataFrame, record_column: str) -> DataFrame:
    """fingerprint, n: layouts without a mapping."""

    def marks(batches):
        for batch in batches:
            got = [canonical(r) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, t in got if t is None], pa.string())], ["fingerprint"])

    return records.select(F.col(record_column).cast("string").alias("record")).mapInArrow(marks, "fingerprint string").groupBy("fingerprint").agg(F.count("*").alias("n"))


def conversations(turns: DataFrame) -> DataFrame:
    """id, formatted (all segments in order), loss_spans (start, end in code points of the whole)."""
    ordered = F.array_sort(F.collect_list(F.struct("record_at", "turn_at", "role", "text", "segment", "loss_start", "loss_end")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"))
    step = lambda acc, t: F.struct(
        (acc["n"] + F.length(t["segment"])).alias("n"),
        F.when(t["loss_end"] > t["loss_start"], F.concat(acc["spans"], F.array(F.struct((acc["n"] + t["loss_start"]).alias("start"), (acc["n"] + t["loss_end"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return turns.groupBy("id").agg(ordered.alias("t")).select("id", F.array_join(F.transform("t", lambda t: t["segment"]), "").alias("formatted"), F.aggregate("t", start, step, lambda acc: acc["spans"]).alias("loss_spans"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from the segments."""

    def digest(batches):
        state = None

        def out(s):
            return pa.RecordBatch.from_arrays([pa.array([s[0]], pa.int64()), pa.array([s[1]]), pa.array([s[2].hexdigest()]), pa.array([s[3]]), pa.array([s[4].hexdigest()]), pa.array([s[5]])], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, segment, a, b in zip(*(batch.column(k).to_pylist() for k in ("id", "segment", "loss_start", "loss_end"))):
                if state is None or conv != state[0]:
                    if state is not None:
                        yield out(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(segment)
                loss = unescape(segment[a:b])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(segment)
        if state is not None:
            yield out(state)

    placed = turns.repartition("id").sortWithinPartitions("id", "record_at", "turn_at", "role", "text").select("id", "segment", "loss_start", "loss_end")
    return placed.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
