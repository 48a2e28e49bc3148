"""Chat formatting by schema fingerprints, in DataFrame functions alone.

The field paths that a layout uses are hashed; the hash picks a declarative mapping to
canonical turns ``array<struct<role, text>>``. Layouts: one row a turn, ``messages``,
``conversations`` (from/value), prompt with completion or response, instruction with
optional input and output. They are recognised for columns of a DataFrame and, row by row,
for JSON strings of mixed layouts.

Defined cases: a null role or text is empty; null turn numbers come last; equal turn numbers
are ordered by role, then text; repeated rows stay as repeated turns; a null conversation id
is a conversation of its own; other columns are ignored; unknown or mixed layouts raise (columns) or
give null turns and the layout ``unmapped`` (JSON rows); empty tables give empty results.
A conversation is one output row, so its turns do meet in one task: its text is the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's marks. Each holds "<|"; escaped texts have a backslash before each "|".
HEAD, SAYS, END = "<|turn|> ", " <|says|> ", " <|end|>\n"
TURNS = "array<struct<role:string,text:string>>"
#: Turns that are summed together, and code points of a stretch, when a formatted string is read back.
GROUP, STRETCH = 128, 512


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths, arrays as []: messages[].role."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.cast("string").alias("text"))


def _listed(name: str, role: str, text: str) -> Callable:
    def mapping(get: Callable[[str, str], Column]) -> Column:
        items = get(name, f"array<struct<{role}:string,{text}:string>>")
        return F.transform(items, lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))

    return mapping


def _asked(ask: str, answer: str, more: str | None = None) -> Callable:
    def mapping(get):
        said = get(ask, "string")
        if more:
            said = F.concat(F.coalesce(said, F.lit("")), F.coalesce(F.concat(F.lit("\n"), F.nullif(get(more, "string"), F.lit(""))), F.lit("")))
        return F.array(_turn("user", said), _turn("assistant", get(answer, "string")))

    return mapping


def _numbered(turn: str, role: str, text: str) -> Callable:
    """A row's one turn behind its number: rows are grouped by their conversation, then put in order."""

    def mapping(get):
        n, said = get(turn, "long"), [F.coalesce(get(x, "string").cast("string"), F.lit("")).alias(y) for x, y in ((role, "role"), (text, "text"))]
        return F.struct(n.isNull().alias("last"), n.alias("turn"), *said)

    return mapping


#: Layout: (its paths, its mapping to turns, or of GROUPED layouts to one turn of a row).
LAYOUTS = {
    "rows": (("conv_id", "turn", "role", "text"), _numbered("turn", "role", "text")),
    "messages": (("messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    "shared": (("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    "completion": (("prompt", "completion"), _asked("prompt", "completion")),
    "response": (("prompt", "response"), _asked("prompt", "response")),
    "instruction": (("instruction", "output"), _asked("instruction", "output")),
    "instruction_input": (("instruction", "input", "output"), _asked("instruction", "output", "input")),
}
GROUPED = frozenset({"rows"})
#: Paths that number conversations and turns, and may stand beside any layout.
NUMBERS = frozenset({"conv_id", "turn"})
KNOWN = frozenset(p for paths, _ in LAYOUTS.values() for p in paths)
BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def layout_of(schema: T.StructType) -> str:
    """The layout that a schema's fingerprint names; paths outside all layouts don't count.

    Rows by turn may have any other columns. Another schema that also has paths of a second layout
    raises, as their text would be lost.
    """
    paths = KNOWN.intersection(field_paths(schema))
    if paths.issuperset(LAYOUTS["rows"][0]):
        return "rows"
    for extra in (frozenset(), NUMBERS):
        if found := BY_FINGERPRINT.get(fingerprint(paths - extra)):
            return found
    raise ValueError(f"no single chat layout has the paths {sorted(field_paths(schema))}")


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): the rows of any known layout as canonical turns."""
    name = layout_of(df.schema)
    made = LAYOUTS[name][1](lambda field, kind: F.col(field))
    if name not in GROUPED:
        return df.select(key, _filled(made).alias("turns"))
    rows = df.select(F.col(key), made.alias("__row")).groupBy(key).agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    return rows.select(key, F.transform("__rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def _filled(turns: Column) -> Column:
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.transform(turns, lambda t: F.struct(blank(t["role"]).alias("role"), blank(t["text"]).alias("text")))


def _element_paths(items: Column, top: str, role: str, text: str) -> Column:
    """The paths that a row's list has; an item whose text would be lost, or no list, adds a path of no layout."""

    def keys(e):
        return F.map_keys(F.try_variant_get(e, "$", "map<string,variant>"))

    def lost(e):
        other = ~F.array_contains(keys(e), text) & (F.size(F.array_except(keys(e), F.array(F.lit(role), F.lit(text)))) > 0)
        return e.isNotNull() & ~F.is_variant_null(e) & (keys(e).isNull() | other)

    has = lambda k: F.exists(items, lambda e: F.coalesce(F.array_contains(keys(e), k), F.lit(False)))
    none = ~has(role) & ~has(text)
    path = lambda k: F.when(has(k) | none, F.lit(f"{top}[].{k}"))
    found = F.array_compact(F.array(path(role), path(text), F.when(F.exists(items, lost), F.lit(f"{top}[]"))))
    return F.coalesce(F.when(items.isNotNull(), found), F.array(F.lit(top)))


def canonical_json(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """(key, layout, turns) of JSON strings whose layouts differ from row to row.

    The paths that a row has are hashed in the row, and the hash picks its mapping. Lists count
    the keys that their items have; a list without any (no items, or empty ones) has no text to
    lose and is of its layout. A list with an item whose text its layout can't reach is unmapped.
    """
    v = F.try_parse_json(F.col(json_col))
    tops = sorted({p.split("[]")[0] for p in KNOWN} - {"conv_id", "turn", "role", "text"})
    inner = {paths[0].split("[]")[0]: [p.split("[].")[1] for p in paths] for paths, _ in LAYOUTS.values() if "[]" in paths[0]}
    parts = [
        F.when(F.try_variant_get(v, f"$.{p}", "variant").isNotNull(), _element_paths(F.try_variant_get(v, f"$.{p}", "array<variant>"), p, *inner[p]) if p in inner else F.array(F.lit(p)))
        .otherwise(F.array().cast("array<string>"))
        for p in tops
    ]
    hashed = F.sha2(F.array_join(F.array_sort(F.concat(*parts)), "\n"), 256)
    named = reduce(lambda c, kv: c.when(hashed == kv[0], F.lit(kv[1])), list(BY_FINGERPRINT.items())[1:], F.when(hashed == list(BY_FINGERPRINT.items())[0][0], F.lit(list(BY_FINGERPRINT.items())[0][1])))
    out = df.select(F.col(key), v.alias("__v"), F.coalesce(named, F.lit("unmapped")).alias("layout"))
    get = lambda field, kind: F.try_variant_get(F.col("__v"), f"$.{field}", kind)
    turns = F.lit(None).cast(TURNS)
    for name, (_, mapping) in LAYOUTS.items():
        if name not in GROUPED:
            turns = F.when(F.col("layout") == name, _filled(mapping(get))).otherwise(turns)
    return out.select(key, "layout", turns.alias("turns"))


def escape(text: Column) -> Column:
    r"""A backslash before each \ and |, so that no mark's "<|" can stand in a text."""
    return F.regexp_replace(text, r"([\\|])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> Column:
    """The formatted string of a conversation."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), escape(t["role"]), F.lit(SAYS), escape(t["text"]), F.lit(END))), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n)


def _before(numbers: Column) -> Column:
    """For each number of an array of longs the sum of those before it, by sums of groups of ``GROUP``.

    A fold that appends to an array would copy it once an item.
    """

    def add(n):
        groups = F.when(F.size(n) > 0, F.sequence(F.lit(0), F.floor((F.size(n) - 1) / GROUP).cast("int"))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(groups, lambda g: _total(F.slice(n, g * GROUP + 1, GROUP)))
        heads = _let(sums, lambda s: F.transform(s, lambda _, g: _total(F.slice(s, 1, g))))
        return _let(heads, lambda h: F.transform(n, lambda _, k: h[F.floor(k / GROUP).cast("int")] + _total(F.slice(n, k - k % GROUP + 1, k % GROUP))))

    return _let(numbers, add)


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted string, with the code-point span of each text in it."""

    def read(parts):
        ends = _before(F.transform(parts, lambda p: (F.length(p) + len(END)).cast("long")))
        return F.zip_with(parts, ends, one)

    def one(part, at):
        role = F.substring_index(F.substr(part, F.lit(len(HEAD) + 1)), SAYS, 1)
        skip = F.length(role) + F.lit(len(HEAD) + len(SAYS))
        return F.struct(
            unescape(role).alias("role"), unescape(F.substr(part, skip + 1)).alias("text"),
            (at + skip).cast("long").alias("start"), (at + F.length(part)).cast("long").alias("end"),
        )

    parts = F.split(formatted, r" <\|end\|>\n", -1)
    return _let(_let(parts, lambda p: F.slice(p, 1, F.size(p) - 1)), read)


def covered(formatted: Column, spans: Column) -> Column:
    """The pieces of a string that code-point spans (start, end) cover.

    The string is cut into stretches of ``STRETCH`` first: a substring is counted from the
    start of its string, so many late ones of a long string would each walk all of it.
    """

    def piece(stretches, s):
        first = F.floor(s["start"] / STRETCH).cast("int")
        last = F.floor((s["end"] - 1) / STRETCH).cast("int")
        near = F.array_join(F.slice(stretches, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.substr(near, (s["start"] - first * STRETCH + 1).cast("int"), (s["end"] - s["start"]).cast("int"))

    stretches = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    return _let(F.struct(stretches.alias("of"), spans.alias("spans")), lambda x: F.transform(x["spans"], lambda s: piece(x["of"], s)))


def format_chats(df: DataFrame, key: str = "conv_id", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(key, formatted, turns, loss_spans): turns and spans are read back from the output.

    loss_spans are the code-point spans of the texts that the loss covers, by role.
    """
    out = canonical_turns(df, key).select(key, format_turns(F.col("turns")).alias("formatted"))
    out = out.select(key, "formatted", read_turns(F.col("formatted")).alias("turns"))
    masked = F.filter("turns", lambda t: t["role"].isin(*loss_roles))
    return out.select(key, "formatted", "turns", F.transform(masked, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"))


def digests(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts and digests of formatted chats, from the formatted strings."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform(covered(F.col("formatted"), F.col("loss_spans")), unescape), "")
    out = chats.select(key, "formatted", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), lost.alias("__lost"))
    return out.select(
        key, "n_turns", "turns_sha256", F.length("__lost").cast("long").alias("loss_chars"), F.sha2(F.col("__lost"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
