"""Chat formatting by schema fingerprints.

A layout is known by the hash of its nested field paths. The hash selects a declarative mapping
that says where the turns are and what their fields are called; the mapping turns
prompts, instructions and message lists into one canonical form, ``(role, text)`` turns in order,
which one template then writes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from matrel.llm._io import table

START, STOP = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``fields``: (role, path) pairs for layouts with a field a turn; several paths of one role are joined
    by an empty line, empty ones left out. ``each``: the list with a turn an element (an empty string: a
    row is a turn), with ``role`` and ``text`` as the names in it. ``roles`` renames roles.
    """

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> frozenset[str]:
        if self.each is None:
            return frozenset(p for _, ps in self.fields for p in ps)
        lead = f"{self.each}[]." if self.each else ""
        return frozenset({lead + self.role, lead + self.text})


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("rows", each="", role="role", text="text"),
    Mapping("messages", each="messages", role="role", text="content", roles=_SPEAKERS),
    Mapping("shared", each="conversations", role="from", text="value", roles=_SPEAKERS),
    Mapping("dialog", each="turns", role="speaker", text="text", roles=_SPEAKERS),
    Mapping("prompt", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction_only", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("system_prompt", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths: Iterator[str] | frozenset[str]) -> str:
    """The hash of a set of nested field paths; their order does not count."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


KNOWN = {fingerprint(m.paths()): m for m in MAPPINGS}
_VOCABULARY = frozenset(p for m in MAPPINGS for p in m.paths())


def schema_paths(kind: T.DataType, lead: str = "") -> frozenset[str]:
    """Leaf paths of a Spark schema; ``[]`` marks a list."""
    if isinstance(kind, T.StructType):
        return frozenset(p for f in kind.fields for p in schema_paths(f.dataType, f"{lead}.{f.name}" if lead else f.name))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{lead}[]")
    return frozenset({lead})


def value_paths(value: object, lead: str = "") -> frozenset[str]:
    """The same of a JSON value; null fields are left out."""
    if isinstance(value, dict):
        return frozenset(p for k, v in value.items() if v is not None for p in value_paths(v, f"{lead}.{k}" if lead else str(k)))
    if isinstance(value, list):
        return frozenset(p for v in value for p in value_paths(v, f"{lead}[]")) or frozenset({f"{lead}[]"})
    return frozenset({lead})


def select(paths: frozenset[str]) -> Mapping | None:
    """The mapping of a layout.

    Paths that no mapping knows (extra columns) don't count. A layout that is then unknown holds some path of another mapping besides its
    own: the largest mapping whose paths it all has is selected, the first in ``MAPPINGS`` of equally large ones. If there is none either, a
    list without elements is known by its name alone. Otherwise there is no mapping.
    """
    known = paths & _VOCABULARY
    found = KNOWN.get(fingerprint(known))
    if found is None:
        inside = [m for m in MAPPINGS if m.paths() <= known]
        found = max(inside, key=lambda m: len(m.paths()), default=None)
    if found is None:
        found = next((m for m in MAPPINGS if m.each and f"{m.each}[]" in paths and not any(p.startswith(f"{m.each}[].") for p in paths)), None)
    return found


def _turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    names = dict(mapping.roles)
    if mapping.each is None:
        out = []
        for role, paths in mapping.fields:
            texts = [str(record[p]) for p in paths if record.get(p) not in (None, "")]
            if texts or any(p in record for p in paths):
                out.append((role, "\n\n".join(texts)))
        return out
    rows = record.get(mapping.each) if mapping.each else [record]
    rows = rows if isinstance(rows, list) else []
    return [(names.get(r := str(x.get(mapping.role) or ""), r), str(x.get(mapping.text) or "")) for x in rows if isinstance(x, dict)]


def turns_from_json(records: DataFrame, column: str = "record", key: str = "conv_id") -> DataFrame:
    """Records of mixed layouts, as JSON texts, to rows ``key, turn, role, text``, with the layout's name as ``layout``.

    Each record's own fingerprint selects its mapping. A record that is null, isn't a JSON object or has an
    unknown layout gives one row with null turn, role, text and layout, one of a known layout without turns a row with
    its layout and the rest null, so that none is lost unseen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, turn, role, text, layout = [], [], [], [], []
            for row, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    record = json.loads(raw) if raw else None
                except ValueError:
                    record = None
                mapping = select(value_paths(record)) if isinstance(record, dict) else None
                found = _turns_of(record, mapping) if mapping else []
                for k, (r, t) in enumerate(found or [(None, None)]):
                    take.append(row)
                    turn.append(k if found else None)
                    role.append(r)
                    text.append(t)
                    layout.append(mapping.name if mapping else None)
            keys = batch.column(0).take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(layout, pa.string())], names=["key", "turn", "role", "text", "layout"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(F.col(key).alias("key"), F.col(column).alias("record")).mapInArrow(run, f"key {kind}, turn long, role string, text string, layout string").withColumnRenamed("key", key)


def canonical_turns(records: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A table of one layout to rows ``key, turn, role, text``; the schema's fingerprint selects the mapping.

    An unknown layout raises ValueError. Nulls in a role or text become empty.
    """
    mapping = select(schema_paths(records.drop(key, order).schema))
    if mapping is None:
        raise ValueError("no mapping for the layout " + ", ".join(sorted(schema_paths(records.schema))))

    def renamed(role: Column) -> Column:
        out = F.coalesce(role, F.lit(""))
        for a, b in mapping.roles:
            out = F.when(role == a, b).otherwise(out)
        return out

    if mapping.each == "":
        return records.select(F.col(key).alias(key), F.col(order).alias("turn"), renamed(F.col(mapping.role)).alias("role"), F.coalesce(F.col(mapping.text), F.lit("")).alias("text"))
    if mapping.each is None:
        made = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[F.col(p).cast("string") for p in paths]), lambda x: x != ""), "\n\n").alias("text")) for role, paths in mapping.fields]
        rows = records.select(F.col(key).alias("key"), F.posexplode(F.array(*made)).alias("turn", "x"))
    else:
        rows = records.select(F.col(key).alias("key"), F.posexplode(mapping.each).alias("turn", "y")).select("key", "turn", F.struct(F.col(f"y.{mapping.role}").alias("role"), F.col(f"y.{mapping.text}").alias("text")).alias("x"))
    return rows.select(F.col("key").alias(key), F.col("turn").cast("long").alias("turn"), renamed(F.col("x.role")).alias("role"), F.coalesce(F.col("x.text"), F.lit("")).alias("text"))


def escape(text: Column) -> Column:
    """Puts one more backslash between every ``<`` and ``|`` (past the backslashes there): no ``<|`` is left, and ``read_chat`` undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, and a line end becomes ``\\n``, so that a role stays on its line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def format_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns to one row a conversation: ``key, formatted, loss_spans``.

    Each turn is ``<|im_start|>role``, a line end, its text and ``<|im_end|>`` with a line end, control strings
    inside escaped. ``loss_spans`` are the (start, stop) code points of the assistant texts in ``formatted``.
    Turns go by ``turn``; ties by role, then text; repeated rows stay; a null turn comes first; null
    roles and texts are empty; a null key is a conversation of its own; an empty table gives none;
    further columns are ignored. A conversation is one string, so it must fit in one row (2 GB).
    """
    rows = turns.select(F.col(key).alias("key"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("key", "turn", "role", "text", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    # A running sum over the sorted turns says where each begins; the window and the grouping share one shuffle.
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + len(STOP) + 1
    ahead = F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(ahead, F.lit(0).cast("long")) + F.length("head")
    placed = rows.select("key", F.row_number().over(order).alias("nth"), F.concat("head", "body", F.lit(STOP + "\n")).alias("piece"), start.alias("start"), (start + F.length("body")).alias("stop"), (F.col("role") == "assistant").alias("loss"))
    chats = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "piece", "start", "stop", "loss"))).alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop")))
    return chats.select(F.col("key").alias(key), F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_chat(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns (role, text) of one formatted conversation, and the text in its spans, unescaped. One step a code point."""
    turns = []
    for part in formatted.split(STOP + "\n")[:-1]:
        role, _, text = part[len(START) :].partition("\n")
        turns.append(("\\".join(x.replace("\\n", "\n") for x in _ESCAPED.sub(r"<\1|", role).split("\\\\")), _ESCAPED.sub(r"<\1|", text)))
    return turns, "".join(_ESCAPED.sub(r"<\1|", formatted[a:b]) for a, b in spans)


def parse_chats(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Back from ``format_chats``: ``key, formatted, turns (array of role, text), loss_text`` (the text under the loss mask, unescaped).

    A null ``formatted`` has no turns and an empty text; null spans are none; an empty table gives an empty one; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, loss = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found, masked = read_chat(text or "", [(s["start"], s["stop"]) for s in spans or []])
                turns.append([{"role": r, "text": t} for r, t in found])
                loss.append(masked)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, _TURNS), pa.array(loss, pa.string())], names=["key", "formatted", "turns", "loss_text"])

    kind = chats.schema[key].dataType.simpleString()
    rows = chats.select(F.col(key).alias("key"), "formatted", "loss_spans")
    return rows.mapInArrow(run, f"key {kind}, formatted string, turns array<struct<role:string,text:string>>, loss_text string").withColumnRenamed("key", key)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings, formatted and read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    rows = canonical_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    back = parse_chats(format_chats(rows))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
