"""Chat formatting with DataFrame operations only.

Records of different layouts sit in one DataFrame, as Spark reads mixed JSON: a
schema that unites all fields, nulls where a record has none. The nested paths
that a record fills are hashed; the hash selects a declarative mapping to
canonical turns ``array<struct<role, text>>``. Turns are then written in one
template and can be read back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from brightloom.llm.common import unused


@dataclass(frozen=True)
class Layout:
    """How one kind of record becomes turns.

    ``required`` and ``optional`` are nested paths (``a.b``, ``list[].field``).
    Either ``each`` names (list, role field, text field), or ``parts`` lists
    (role, paths): one turn per entry whose paths are filled, joined by a blank line.
    ``roles`` renames roles; others stay as they are.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def path_sets(self) -> list[frozenset[str]]:
        chosen = [c for k in range(len(self.optional) + 1) for c in combinations(self.optional, k)]
        sets = [frozenset(self.required + c) for c in chosen]
        return [*sets, *[frozenset((f"{self.each[0]}[]", *c)) for c in chosen]] if self.each else sets


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout(
        "conversations", ("conversations[].from", "conversations[].value"), ("system",),
        each=("conversations", "from", "value"), parts=(("system", ("system",)),),
        roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Layout(
        "instruction", ("instruction", "output"), ("input", "system"),
        parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), parts=(
        ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), parts=(
        ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", ("question", "answer"), ("context",), parts=(
        ("user", ("context", "question")), ("assistant", ("answer",)))),
)

START, END = "<|turn|>", "<|end|>"
#: Strings with a meaning in chat templates; none may appear unescaped in a text.
CONTROL = (
    START, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)


def fingerprint_of(paths: Sequence[str]) -> str:
    return hashlib.md5(",".join(sorted(paths)).encode()).hexdigest()


def _has(name: str) -> Callable[[Column], Column]:
    return lambda element: element[name].isNotNull()


def _filled(schema: StructType, base: str = "", at: Column | None = None) -> list[tuple[str, Column]]:
    """(path, whether a record fills it) for every leaf of a schema."""
    found: list[tuple[str, Column]] = []
    for field in schema.fields:
        path = f"{base}{field.name}"
        here = F.col(f"`{field.name}`") if at is None else at[field.name]
        if isinstance(field.dataType, StructType):
            found += _filled(field.dataType, f"{path}.", here)
        elif isinstance(field.dataType, ArrayType):
            inner = field.dataType.elementType
            if isinstance(inner, StructType):
                found.append((f"{path}[]", F.size(here) == 0))
                found += [(f"{path}[].{sub.name}", F.exists(here, _has(sub.name))) for sub in inner.fields]
            else:
                found.append((f"{path}[]", here.isNotNull()))
        else:
            found.append((path, here.isNotNull()))
    return found


def fingerprint(records: DataFrame, fields: Sequence[str]) -> Column:
    """MD5 of the sorted nested paths that a record fills, over the columns ``fields``."""
    paths = _filled(StructType([records.schema[c] for c in fields]))
    names = F.array_compact(F.array(*[F.when(present, F.lit(path)) for path, present in paths]))
    return F.md5(F.array_join(F.array_sort(names), ",").cast("binary"))


def _value(path: str) -> Column:
    first, *rest = path.split(".")
    column = F.col(f"`{first}`")
    for name in rest:
        column = column[name]
    return column.cast("string")


def _renamed(role: Column, layout: Layout) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in layout.roles:
        role = F.when(role == old, new).otherwise(role)
    return role


def _turns(layout: Layout, known: set[str]) -> Column:
    single = []
    for role, paths in layout.parts:
        values = [_value(p) for p in paths if p in known]
        if values:
            single.append(F.when(
                F.coalesce(*values).isNotNull(),
                F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *values).alias("text")),
            ))
    head = F.array_compact(F.array(*single)) if single else None
    if layout.each is None:
        return head
    listed, role, text = layout.each
    rows = F.transform(F.col(f"`{listed}`"), lambda m: F.struct(
        _renamed(m[role], layout).alias("role"), F.coalesce(m[text].cast("string"), F.lit("")).alias("text")
    ))
    return rows if head is None else F.concat(head, rows)


def canonical_turns(
    records: DataFrame, fields: Sequence[str], layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """Adds ``layout_fingerprint``, ``layout`` and ``turns`` to each record.

    Only ``fields`` count as the record; other columns (ids, notes) stay as they
    are. A null role or text inside a list is empty. A record whose fingerprint
    no mapping knows - an all-null one too - keeps its fingerprint and gets null
    layout and turns; none is dropped. Columns of the three names are replaced.
    """
    known = {path for path, _ in _filled(StructType([records.schema[c] for c in fields]))}
    print_, name, turns = unused(records, "_print"), F.lit(None).cast("string"), F.lit(None).cast(
        "array<struct<role:string,text:string>>"
    )
    marked = records.withColumn(print_, fingerprint(records, fields))
    for layout in layouts:
        prints = [fingerprint_of(s) for s in layout.path_sets() if s <= known]
        if prints:
            hit = F.col(print_).isin(prints)
            name = F.when(hit, layout.name).otherwise(name)
            turns = F.when(hit, _turns(layout, known)).otherwise(turns)
    out = marked.withColumns({"layout": name, "turns": turns, "layout_fingerprint": F.col(print_)})
    return out.drop(print_)


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|/<>" and c not in "/<>-" else c for c in text)


#: First character, any backslashes, rest of a control string. One more backslash breaks the string; one less restores it.
_BREAK = r"([<\[])(\\*(?:" + "|".join(_literal(c[1:]) for c in sorted(CONTROL, key=len, reverse=True)) + "))"
_MEND = r"([<\[])\\(\\*(?:" + "|".join(_literal(c[1:]) for c in sorted(CONTROL, key=len, reverse=True)) + "))"


def escape(text: Column) -> Column:
    """Put one backslash behind the first character of every (possibly escaped) control string."""
    return F.regexp_replace(text, _BREAK, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _MEND, "$1$2")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_turns(turns: Column) -> Column:
    """``<|turn|>role\\ntext<|end|>\\n`` per turn. No turns give an empty text, null turns a null."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n")
    )), "")


def loss_mask(turns: Column, trained: str = "assistant") -> Column:
    """One flag per turn of the output: its text, without header and end mark, counts for the loss."""
    return F.transform(turns, lambda t: t["role"] == trained)


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped: the exact inverse of :func:`format_turns`."""
    pieces = F.split(formatted, _literal(END) + "\n")
    cut = lambda p: F.locate("\n", p)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        _unescape_role(F.substring(p, F.lit(len(START) + 1), cut(p) - len(START) - 1)).alias("role"),
        unescape(F.substring(p, cut(p) + 1, F.length(p))).alias("text"),
    ))


def format_records(
    records: DataFrame, fields: Sequence[str], layouts: Sequence[Layout] = LAYOUTS, trained: str = "assistant"
) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` to what :func:`canonical_turns` gives; both null for unmapped records."""
    done = canonical_turns(records, fields, layouts)
    return done.withColumns({"formatted": format_turns(F.col("turns")), "loss_mask": loss_mask(F.col("turns"), trained)})


def gather(rows: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """One record (key, messages) per conversation from one row per turn.

    Turns come in ``order`` (null first), then by role and text; repeated rows
    stay. Null roles and texts are empty; a null key is one conversation. A
    conversation is one output row, so its size is bounded by what a row holds.
    """
    turn = F.struct(
        F.col(order).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    )
    listed = rows.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return listed.select(key, F.transform("_turns", lambda t: F.struct(t["role"], t["content"])).alias("messages"))
