"""Chat formatting: records of many layouts -> canonical turns -> one formatted text.

A record is a variant value.  Its schema, without the value types, is the list of its nested
field paths; the hash of that is the layout's fingerprint, and selects one of the declarative
``LAYOUTS``, which say where turns, roles and texts are.  A record whose fingerprint no
layout has is kept, with null turns.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside roles
and texts are escaped reversibly: a backslash becomes ``\\0`` and the k-th control string
``\\k``, so no control string is left, and every backslash begins an escape.  The loss mask is
the list of character spans of the assistant texts.  ``read_back`` restores turns and loss
text from the formatted text and the spans alone.

Everything is DataFrame functions.

Defined results: null texts and roles are empty; turns of one number are ordered by role and
text; rows without a turn number come first; repeated rows are repeated turns; a record
without turns gives an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of public chat templates (fixed values); at most nine.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = CONTROL[0], CONTROL[1]
TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are: either a list of objects with a role and a text
    field, or one field for each turn in the given order."""
    name: str
    many: tuple[str, str, str] | None = None            # (list field, role field, text field)
    one: tuple[tuple[str, str], ...] = ()               # (role, field) in order
    roles: dict = field(default_factory=dict, hash=False)   # names of roles in the record

    def shape(self) -> str:
        """Field paths as the type-less schema of a variant (its fields are sorted)."""
        if self.many:
            top, *inner = self.many
            return f"OBJECT<{top}: ARRAY<OBJECT<{', '.join(sorted(inner))}>>>"
        return f"OBJECT<{', '.join(sorted(f for _, f in self.one))}>"

    def turns(self, v: Column) -> Column:
        if not self.many:
            return F.array(*[F.struct(F.lit(role).alias("role"), F.variant_get(v, f"$.{f}", "string").alias("text"))
                             for role, f in self.one]).cast(TURN)
        top, role, text = self.many
        rows = F.variant_get(v, f"$.{top}", f"array<struct<{role}:string,{text}:string>>")

        def canonical(t: Column) -> Column:
            name = t[role]
            for theirs, ours in self.roles.items():
                name = F.when(t[role] == theirs, F.lit(ours)).otherwise(name)
            return F.struct(name.alias("role"), t[text].alias("text"))
        return F.transform(rows, canonical).cast(TURN)


LAYOUTS = (
    Layout("messages", many=("messages", "role", "content")),
    Layout("shared", many=("conversations", "from", "value"),
           roles={"human": "user", "gpt": "assistant", "system": "system"}),
    Layout("prompt", one=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt", one=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", one=(("user", "instruction"), ("assistant", "output"))),
    Layout("question", one=(("user", "question"), ("assistant", "answer"))),
)

_TYPE = r": (?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\s*\d+\))"


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant."""
    return F.sha2(F.regexp_replace(F.schema_of_variant(record), _TYPE, ""), 256)


def canonical_turns(records: DataFrame, record: str, out: str = "turns", layout: str = "layout",
                    layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add the layout's name and the canonical turns (null where no layout fits)."""
    shape = fingerprint(F.col(record))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for one in layouts:
        hit = F.col("_shape") == F.sha2(F.lit(one.shape()), 256)
        name = F.when(hit, F.lit(one.name)).otherwise(name)
        turns = F.when(hit, one.turns(F.col(record))).otherwise(turns)
    return records.withColumn("_shape", shape).withColumn(layout, name).withColumn(out, turns).drop("_shape")


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\0"))
    for k, s in enumerate(CONTROL, 1):
        c = F.replace(c, F.lit(s), F.lit(f"\\{k}"))
    return c


def unescape(c: Column) -> Column:
    for k, s in enumerate(CONTROL, 1):
        c = F.replace(c, F.lit(f"\\{k}"), F.lit(s))
    return F.replace(c, F.lit("\\0"), F.lit("\\"))


def _role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def format_turns(df: DataFrame, turns: str = "turns", out: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """Add the formatted text and the loss mask as spans (start, length) in characters."""
    parts = F.transform(F.col(turns), lambda t: F.struct(
        F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("loss")))
    df = df.withColumn("_parts", F.coalesce(parts, F.expr("array()").cast("array<struct<head:string,body:string,loss:boolean>>")))
    tail = len(END) + 1
    state = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>))")

    def step(a: Column, p: Column) -> Column:
        head, body = F.length(p["head"]).cast("long"), F.length(p["body"]).cast("long")
        span = F.array(F.struct((a["at"] + head).alias("start"), body.alias("length")))
        return F.struct((a["at"] + head + body + tail).alias("at"),
                        F.when(p["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return (df.withColumn(out, text).withColumn(spans, F.aggregate("_parts", state, step, lambda a: a["spans"]))
            .drop("_parts"))


def read_back(df: DataFrame, formatted: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """Add ``turns_back`` (role, text) and ``loss_text``, restored from the formatted text."""
    raw = F.split(F.col(formatted), "<\\|im_end\\|>\n", -1)
    raw = F.slice(raw, 1, F.size(raw) - 1)

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        name = F.replace(F.substring(role, len(START) + 1, 1 << 30), F.lit("\\n"), F.lit("\n"))
        return F.struct(unescape(name).alias("role"),
                        unescape(t.substr(F.length(role) + 2, F.length(t))).alias("text"))

    loss = F.transform(F.col(spans), lambda s: unescape(
        F.col(formatted).substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return df.withColumn("turns_back", F.transform(raw, turn)).withColumn("loss_text", F.array_join(loss, ""))


def from_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """Rows by turn -> (conv, record): each conversation as a record of one of the layouts,
    by its shape: one prompt and answer, the same after a system text, or a list.  A single
    conversation is gathered in one row, as its output is one text."""
    t = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text"))
    g = rows.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(t)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    text_of = lambda k: F.col("t")[k]["text"]

    def same(*names):
        return roles == F.array(*[F.lit(n) for n in names])

    plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    theirs = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    record = (
        F.when(same("user", "assistant"), F.to_variant_object(F.struct(
            text_of(0).alias("prompt"), text_of(1).alias("completion"))))
        .when(same("system", "user", "assistant"), F.to_variant_object(F.struct(
            text_of(0).alias("system"), text_of(1).alias("prompt"), text_of(2).alias("response"))))
        .when(plain & (F.size("t") % 2 == 0), F.to_variant_object(F.struct(F.transform("t", lambda x: F.struct(
            theirs(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_variant_object(F.struct(F.transform("t", lambda x: F.struct(
            x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))))
    return g.select("conv", record.alias("record"))


def digests(df: DataFrame, id_col: str, formatted: str = "formatted") -> DataFrame:
    """Digest columns of formatted conversations, read back from the output."""
    b = read_back(df, formatted)
    turns = F.array_join(F.transform("turns_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return b.select(id_col, F.size("turns_back").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                    F.length(formatted).cast("long").alias("formatted_chars"))


def oracle_sql() -> str:
    """DuckDB SQL for ``op9``: the same digests straight from the table."""
    def escaped(column: str) -> str:
        out = f"replace({column}, chr(92), chr(92) || '0')"
        for k, s in enumerate(CONTROL, 1):
            out = f"replace({out}, '{s}', chr(92) || '{k}')"
        return out

    role, esc = f"replace({escaped('role')}, chr(10), chr(92) || 'n')", escaped("text")
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum({len(START) + len(END) + 2} + length({role}) + length({esc})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
