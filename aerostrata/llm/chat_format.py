"""Chat formatting by a finite-state machine over roles.

A template is data: the text before and after a turn of each role, the roles that may follow, whose text is learnt.
Turns come sorted by conversation and turn; the machine checks their order, emits segments (text, learnt or not), and
marks a conversation whose order breaks the rules as invalid without dropping a turn. Control strings inside a text
are broken up with backslashes, reversibly, so that the formatted conversation can be read back.

A conversation is never held whole: a task streams over the segments of sorted turns, reads them back as one text whose
turns it has to find, and carries only the running state and an open turn. Digests of a conversation are sequential, so
a conversation is one task's work.

Cases: null text counts as empty; a null or unknown role is formatted as the template's fallback and makes the
conversation invalid; turns with equal numbers are ordered by role and text; a null conversation is a group of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm.common import append_columns, table


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    follows: tuple[str, ...]  # roles (or "start") after which this one may come
    learnt: bool = False


@dataclass(frozen=True)
class Template:
    """Roles in order of preference; the name stands between the fallback's marks for roles that are not listed."""

    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>\n", "\n<</SYS>>\n", ("start",)),
            "user": Role("[INST] ", " [/INST]", ("start", "system", "assistant")),
            "assistant": Role("<s>", "</s>\n", ("user",), learnt=True),
        }
    )
    other: Role = Role("<|role|>", "<|end|>\n", ())
    other_sep: str = "<|text|>"
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        marks = [m.strip() for r in [*self.roles.values(), self.other] for m in (r.before, r.after)] + [self.other_sep]
        return sorted({m for m in marks if m}, key=lambda m: (-len(m), m))


class Machine:
    """Transitions, segments and the way back for one template."""

    def __init__(self, template: Template):
        self.template = template
        self._inside = re.compile(f"(?=(?:{'|'.join(map(re.escape, template.controls()))}))(.)", re.DOTALL)
        heads = "|".join(f"(?P<r{i}>{re.escape(r.before)})" for i, r in enumerate(template.roles.values()))
        self.head = re.compile(f"{heads}|(?P<other>{re.escape(template.other.before)})")
        self.names = list(template.roles)

    def escape(self, text: str) -> str:
        """Double backslashes and put one after the first character of every control string."""
        return self._inside.sub(r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.?)", r"\1", text, flags=re.DOTALL)

    def step(self, state: str, role: str | None) -> tuple[str, bool]:
        """Next state and whether the role may come now."""
        known = self.template.roles.get(role) if role is not None else None
        return (role if known else "other"), bool(known and state in known.follows)

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        """(text, learnt) pieces of one turn."""
        body = self.escape(text or "")
        r = self.template.roles.get(role) if role is not None else None
        if r is None:
            name = "\\0" if role is None else self.escape(role)
            return [(self.template.other.before + name + self.template.other_sep, False), (body, False), (self.template.other.after, False)]
        return [(r.before, False), (body, r.learnt), (r.after, False)]

    def reader(self) -> Reader:
        return Reader(self)

    def read(self, formatted: str) -> Iterator[tuple[str | None, str]]:
        """(role, text) of each turn of a whole formatted conversation."""
        reader = self.reader()
        yield from reader.feed(formatted)
        reader.close()


class Reader:
    """Reads a formatted conversation back from a stream of its text, cut anywhere; it holds one turn at a time."""

    def __init__(self, machine: Machine):
        self.machine, self.held, self.sought = machine, "", 0

    def feed(self, text: str) -> Iterator[tuple[str | None, str]]:
        """Turns that are complete now."""
        self.held += text
        at, template = 0, self.machine.template
        while at < len(self.held):
            m = self.machine.head.match(self.held, at)
            if m is None:
                break  # the beginning of a mark, or an error that close() reports
            other = m.lastgroup == "other"
            name = None if other else self.machine.names[int(m.lastgroup[1:])]
            after = (template.other if other else template.roles[name]).after
            end = self.held.find(after, max(m.end(), self.sought))
            if end < 0:
                self.sought = max(m.end(), len(self.held) - len(after) + 1)
                break
            body = self.held[m.end() : end]
            if other:
                name, _, body = body.partition(template.other_sep)
                name = None if name == "\\0" else self.machine.unescape(name)
            yield name, self.machine.unescape(body)
            at, self.sought = end + len(after), 0
        self.held = self.held[at:]
        self.sought = max(0, self.sought - at)

    def close(self) -> None:
        if self.held:
            raise ValueError(f"no whole turn at {self.held[:40]!r}")


def _segments(df: DataFrame, machine: Machine, conv: str, turn: str, role: str, text: str) -> DataFrame:
    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("learnt", T.BooleanType())]))
    found = append_columns(
        df.select(conv, turn, role, text),
        [F.col(role), F.col(text)],
        [T.StructField("segments", kind)],
        lambda roles, texts: [[[{"text": s, "learnt": f} for s, f in machine.segments(r, t)] for r, t in zip(roles, texts, strict=True)]],
        keep=[conv, turn],
    )
    return found.select(conv, turn, F.posexplode("segments").alias("segment", "s")).select(conv, turn, "segment", "s.text", "s.learnt")


def format_turns(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of every turn: (conv, turn, segment, text, learnt), in a row each. Needs no grouping."""
    return _segments(df, Machine(template or Template()), conv, turn, role, text)


def summarise(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Format each conversation, read its segments back as one text and digest what was read, streaming over them.

    One row per conversation: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, n_segments. Turns come from
    the text alone, whose boundaries the reader has to find; learnt text from the flags of the segments alone.
    """
    machine = Machine(template or Template())
    longs, texts = T.LongType(), T.StringType()
    names = [("n_turns", longs), ("turns_sha256", texts), ("loss_chars", longs), ("loss_sha256", texts), ("formatted_chars", longs), ("valid", T.BooleanType()), ("n_segments", longs)]
    schema = T.StructType([df.schema[conv], *[T.StructField(n, t) for n, t in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now, has, done = None, False, []
        n = chars = loss = segments = 0
        turns = learnt = reader = None
        state, valid = "start", True

        def close():
            reader.close()
            done.append((now, n, turns.hexdigest(), loss, learnt.hexdigest(), chars, valid and state in machine.template.final, segments))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for key, piece, flag in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if not has or key != now:
                    if has:
                        close()
                    now, has = key, True
                    n = chars = loss = segments = 0
                    turns, learnt, reader = hashlib.sha256(), hashlib.sha256(), machine.reader()
                    state, valid = "start", True
                segments += 1
                chars += len(piece)
                if flag:
                    plain = machine.unescape(piece)
                    loss += len(plain)
                    learnt.update(plain.encode())
                for r, t in reader.feed(piece):
                    n += 1
                    turns.update(f"{r if r is not None else ''}\n{t}\n".encode())
                    state, fine = machine.step(state, r)
                    valid &= fine
            if done:
                yield flush()
                done.clear()
        if has:
            close()
            yield flush()

    ordered = df.select(conv, turn, role, text).repartition(F.col(conv)).sortWithinPartitions(conv, turn, role, text)
    # formatting and exploding keep the order of rows in a partition
    return _segments(ordered, machine, conv, turn, role, text).select(conv, "text", "learnt").mapInArrow(run, schema)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the fixed conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return summarise(rows.unionByName(extra))


def _oracle() -> str:
    template = Template()

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    marks = " ".join(f"WHEN '{name}' THEN {len(r.before) + len(r.after)}" for name, r in template.roles.items())
    escapes = " + ".join(["length(text) - length(replace(text, '\\', ''))", *(f"(length(text) - length(replace(text, {quoted(c)}, ''))) // {len(c)}" for c in template.controls())])
    steps = " OR ".join(f"(role = '{name}' AND coalesce(prev, 'start') IN ({', '.join(repr(f) for f in r.follows)}))" for name, r in template.roles.items())
    learnt = "role IN (" + ", ".join(f"'{name}'" for name, r in template.roles.items() if r.learnt) + ")"
    final = ", ".join(f"'{f}'" for f in template.final)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next, row_number() OVER w AS k FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE {learnt}), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE {learnt}), '')) AS loss_sha256,
  CAST(sum(CASE role {marks} END + length(text) + {escapes}) AS BIGINT) AS formatted_chars,
  bool_and({steps}) AND bool_and(next IS NOT NULL OR role IN ({final})) AS valid, 3 * count(*) AS n_segments
FROM o GROUP BY conv_id
"""


#: The same digests in SQL, for tables whose roles are those of the template.
ORACLE = _oracle()
