"""Chat formatting by schema fingerprint, with SQL functions only.

A layout is recognised by the hash of its nested field paths; the hash selects
a declarative mapping into canonical turns, array<struct<role, text>>. Turns
are then written with one template whose control strings are escaped inside
texts, and can be read back from the formatted string alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

TURN, TEXT, END = "<|turn|>", "\n<|text|>", "\n<|end|>"
#: Strings that may not occur unescaped inside a role or a text.
CONTROL = r"<\|(?:turn|text|end)\|>|</?s>|\[/?INST\]|<</?SYS>>"
TURNS = "array<struct<role:string,text:string>>"


def _paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return _paths(kind.elementType, at + "[]")
    return [at]


def _turns(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("text")) for role, text in pairs])


#: A field of a row by its name, a null where the layout's optional field is absent.
Fields = Callable[[str], Column]


def _listed(items: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Fields], Column]:
    def one(x: Column) -> Column:
        r = x[role]
        for old, new in (names or {}).items():
            r = F.when(x[role] == old, new).otherwise(r)
        return F.struct(r.alias("role"), x[text].alias("text"))

    return lambda field: F.transform(field(items), one)


def _asked(user: str, assistant: str) -> Callable[[Fields], Column]:
    return lambda field: _turns(("user", field(user)), ("assistant", field(assistant)))


def _instruction(field: Fields) -> Column:
    more = F.coalesce(field("input"), F.lit(""))
    asked = F.concat(F.coalesce(field("instruction"), F.lit("")), F.when(more != "", F.concat(F.lit("\n\n"), more)).otherwise(""))
    return _turns(("user", asked), ("assistant", field("output")))


@dataclass(frozen=True)
class Mapping:
    """paths: the nested fields of a layout, of which ``optional`` may be absent; turns: its canonical turns, or None for a row of a table per turn."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: Callable[[Fields], Column] | None
    optional: tuple[str, ...] = ()

    @property
    def fingerprints(self) -> list[str]:
        return [fingerprint_of(set(self.paths) - set(self.optional[:n])) for n in range(len(self.optional) + 1)]


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), "", None),
    Mapping("messages", ("messages[].role", "messages[].content"), "messages array<struct<role:string,content:string>>", _listed("messages", "role", "content")),
    Mapping("shared", ("conversations[].from", "conversations[].value"), "conversations array<struct<`from`:string,value:string>>", _listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Mapping("prompt", ("prompt", "response"), "prompt string, response string", _asked("prompt", "response")),
    Mapping("completion", ("prompt", "completion"), "prompt string, completion string", _asked("prompt", "completion")),
    Mapping("instruction", ("instruction", "input", "output"), "instruction string, input string, output string", _instruction, optional=("input",)),
)
BY_FINGERPRINT = {f: m for m in MAPPINGS for f in m.fingerprints}
#: Paths that tell layouts apart; others (extra columns) take no part in a fingerprint.
KNOWN = frozenset(p for m in MAPPINGS for p in m.paths) - {"conv_id"}


def layout_of(df: DataFrame) -> Mapping:
    """The mapping for a table's schema; extra columns are ignored, an unknown layout raises ValueError."""
    paths = set(_paths(df.schema))
    telling = paths & KNOWN
    extra = {"conv_id"} if {"turn", "role"} <= telling and "conv_id" in paths else set()
    found = BY_FINGERPRINT.get(fingerprint_of(telling | extra))
    if not found:
        raise ValueError(f"no mapping for fields {sorted(paths)}")
    return found


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) of a table in any known layout.

    Rows by turn are gathered per key, ordered by (turn, role, text) with nulls
    first; repeated rows stay. Null roles and texts become empty, a null key is
    a conversation of its own. Other layouts keep one row for each input row,
    and a null list has no turns.
    """
    layout = layout_of(df)
    if layout.turns:
        turns = layout.turns(lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string"))
        out = df.select(F.col(key), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))
    else:
        empty = F.lit("")
        row = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
        rows = df.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
        out = rows.select(key, F.transform("rows", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns"))
    filled = F.transform("turns", lambda x: F.struct(F.coalesce(x.role, F.lit("")).alias("role"), F.coalesce(x.text, F.lit("")).alias("text")))
    return out.select(key, filled.alias("turns"))


def canonical_json(df: DataFrame, json: str, key: str = "conv_id") -> DataFrame:
    """(key, layout, turns) for a column of JSON records whose layouts differ by row.

    A record's fingerprint is made of those KNOWN paths that it has, told by the
    keys of the record and of the first element of its lists, so that further
    fields are ignored as in tables. Broken JSON, empty lists and unknown
    layouts give null layout and turns; no row is lost.
    """
    record = F.col(json)
    lists = sorted({p.split("[]")[0] for p in KNOWN if "[]" in p})
    keys = {name: F.json_object_keys(F.get_json_object(record, f"$.{name}[0]")) for name in lists} | {"": F.json_object_keys(record)}

    def present(path: str) -> Column:
        outer, _, inner = path.rpartition("[].")
        return F.when(F.array_contains(keys[outer], inner), path)

    paths = F.array_compact(F.array(*[present(p) for p in sorted(KNOWN)]))
    out = df.select(F.col(key), record.alias("__json"), F.sha2(F.array_join(paths, "\n"), 256).alias("__print"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in (m for m in MAPPINGS if m.turns):
        hit = F.col("__print").isin(m.fingerprints)
        read = F.from_json("__json", m.schema)
        layout, turns = F.when(hit, m.name).otherwise(layout), F.when(hit, m.turns(read.getField)).otherwise(turns)
    return out.select(key, layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """One backslash more before each control string and the backslashes that lead up to it; a run of them is tried from its start only."""
    return F.regexp_replace(text, rf"(?<!\\)(\\*+)({CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+)({CONTROL})", "$1$2")


def format_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss_mask) from (key, turns).

    loss_mask has one (skip, take) for each turn: characters of the turn before
    those that count for the loss, and how many do (all of an assistant's text,
    else 0). A control string of the template always follows a character that is
    no backslash, so a text's own trailing backslashes can't disguise it.
    """
    safe = F.transform("turns", lambda x: F.struct(escape(x.role).alias("role"), escape(x.text).alias("text"), (x.role == "assistant").alias("loss")))
    out = df.select(key, safe.alias("__safe"))
    written = F.transform("__safe", lambda x: F.concat(F.lit(TURN), x.role, F.lit(TEXT), x.text, F.lit(END)))
    mask = F.transform(
        "__safe",
        lambda x: F.struct(
            (F.length(x.role) + len(TURN) + len(TEXT)).alias("skip"),
            F.when(x.loss, F.length(x.text)).otherwise(0).alias("take"),
        ),
    )
    return out.select(key, F.array_join(written, "").alias("formatted"), mask.alias("loss_mask"))


def read_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns, loss_texts, formatted) from the formatted string and its mask."""
    blocks = F.split("formatted", r"(?<!\\)<\|turn\|>", -1)
    out = df.select(key, "formatted", "loss_mask", F.slice(blocks, F.lit(2), F.size(blocks)).alias("__blocks"))
    at = lambda b: F.instr(b, TEXT)
    turn = lambda b: F.struct(
        unescape(F.substring(b, F.lit(1), at(b) - 1)).alias("role"),
        unescape(F.substring(b, at(b) + len(TEXT), F.length(b) - at(b) + 1 - len(TEXT) - len(END))).alias("text"),
    )
    lost = F.transform("__blocks", lambda b, i: F.substring(b, F.get("loss_mask", i).skip - len(TURN) + 1, F.get("loss_mask", i).take))
    return out.select(key, F.transform("__blocks", turn).alias("turns"), F.transform(lost, unescape).alias("loss_texts"), "formatted")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from the formatted output; turns of a conversation -1 in the table join the two added ones."""
    said = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_turns(format_turns(canonical(rows.unionByName(own))))
    told = F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n")))
    loss = back.select("conv_id", "turns", "formatted", F.array_join("loss_texts", "").alias("loss"))
    return loss.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = rf"length(regexp_replace({{}}, '(\\*)({CONTROL})', '\\\1\2', 'g'))"
OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN) + len(TEXT) + len(END)} + {_ESCAPED.format('role')} + {_ESCAPED.format('text')})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
