"""Record specifications compiled to one DataFrame projection."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import predicate
from ..functions.transforms import FLAT_MAPS, Options, then, transform
from .lookups import join_lookups

_PHASES = ("inline", "derived", "constants")


class Scope:
    """Named values in reach of a field, with their types. ``there`` tells which rows have the object at all (None: all)."""

    there: Column | None = None

    def __init__(self, values: dict[str, tuple[Column, T.DataType]]):
        self.values = values

    @classmethod
    def of(cls, schema: T.StructType, get: Callable[[str], Column]) -> Scope:
        return cls({f.name: (get(f.name), kind_of(f)) for f in schema.fields})

    def has(self, name: str) -> bool:
        return name in self.values

    def col(self, name: str) -> Column:
        return self.values[name][0]

    def type(self, name: str) -> T.DataType:
        return self.values[name][1]

    def present(self, name: str) -> Column | None:
        """Whether a row has the key; None where every row has."""
        return None

    def where_present(self, name: str, value: Column) -> Column:
        there = self.present(name)
        return value if there is None else F.when(there, value)

    def names(self) -> list[str]:
        return list(self.values)

    def inside(self, path: str) -> Scope | None:
        """The nested object at a dotted path, a number being a place in an array; None where a step is not there."""
        here = self
        for step in path.split("."):
            if not here.has(step):
                return None
            here = scope_of(here.col(step), here.type(step))
            if here is None:
                return None
        return here


class _MapScope(Scope):
    """A map column's keys as fields; a key that a row lacks is absent."""

    def __init__(self, c: Column, value: T.DataType):
        super().__init__({})
        self.c, self.value, self.there = c, value, c.isNotNull()

    def has(self, name):
        return True

    def col(self, name):
        return F.try_element_at(self.c, F.lit(name))

    def type(self, name):
        return self.value

    def present(self, name):
        return F.coalesce(F.map_contains_key(self.c, F.lit(name)), F.lit(False))


class _ArrayScope(Scope):
    """An array's places, from 0, as fields; a place beyond its end is absent."""

    def __init__(self, c: Column, item: T.DataType):
        super().__init__({})
        self.c, self.item = c, item

    def has(self, name):
        return name.isdigit()

    def col(self, name):
        return F.get(self.c, F.lit(int(name)))

    def type(self, name):
        return self.item

    def present(self, name):
        return F.coalesce(F.size(self.c) > int(name), F.lit(False))


class Ragged(T.StructType):
    """The type of objects held as VARIANT, whose keys may be absent; its fields are the keys that occur."""


class _RaggedScope(Scope):
    """A VARIANT object's keys as fields: a missing key is absent, a JSON null is null."""

    def __init__(self, c: Column, kind: Ragged):
        super().__init__({f.name: (None, kind_of(f)) for f in kind.fields})
        self.c, self.there = c, c.isNotNull()

    def _get(self, name: str, kind: str) -> Column:
        mark = next((m for m in "'\"" if m not in name), None)
        if mark is None:  # a path cannot quote a name that holds both marks
            return F.try_variant_get(F.try_element_at(F.try_variant_get(self.c, "$", "map<string,variant>"), F.lit(name)), "$", kind)
        return F.try_variant_get(self.c, f"$[{mark}{name}{mark}]", kind)

    def col(self, name):
        return self._get(name, stored(self.type(name)))

    def present(self, name):
        return self._get(name, "variant").isNotNull()


def stored(kind: T.DataType) -> str:
    """The type to take out of a VARIANT: objects stay VARIANT, alone and in arrays."""
    if isinstance(kind, Ragged):
        return "variant"
    if isinstance(kind, T.ArrayType):
        return f"array<{stored(kind.elementType)}>"
    return kind.simpleString()


def ragged(kind: T.DataType) -> T.DataType:
    """A type found in JSON text with every object in it Ragged."""
    if isinstance(kind, T.StructType):
        return Ragged([T.StructField(f.name, ragged(f.dataType)) for f in kind.fields])
    return T.ArrayType(ragged(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def kind_of(f: T.StructField) -> T.DataType:
    """A field's type; of a VARIANT the one that its metadata tells under 'record' (see sources.ragged_records)."""
    if isinstance(f.dataType, T.VariantType) and "record" in (f.metadata or {}):
        return ragged(T.StructType.fromJson(json.loads(f.metadata["record"])))
    return f.dataType


def scope_of(c: Column, kind: T.DataType) -> Scope | None:
    """What is inside a value; None for scalars."""
    if isinstance(kind, Ragged):
        return _RaggedScope(c, kind)
    if isinstance(kind, T.StructType):
        return Scope.of(kind, c.getField)
    if isinstance(kind, T.MapType):
        return _MapScope(c, kind.valueType)
    return _ArrayScope(c, kind.elementType) if isinstance(kind, T.ArrayType) else None


@dataclass(frozen=True)
class Spec:
    """A validated specification; the configuration it comes from is never changed."""

    inline: tuple[dict, ...] = ()
    derived: tuple[dict, ...] = ()
    constants: tuple[dict, ...] = ()
    export: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, config: dict) -> Spec:
        for phase in _PHASES:
            names = [f["name"] for f in config.get(phase) or ()]
            if twice := {n for n in names if names.count(n) > 1}:
                raise ValueError(f"{phase}: {sorted(twice)} defined twice")
        if sum(f.get("type") == "extended_array" for f in config.get("inline") or ()) > 1:
            raise ValueError("one extended_array is possible per level")
        return cls(*(tuple(config.get(p) or ()) for p in _PHASES), dict(config.get("export") or {}))


def _guarded(f: dict, scope: Scope, value: Callable[[], Column], source: str | None, o: Options) -> Column:
    """``ignore``: where its condition holds ``then`` (a scalar or a transform) replaces the value; where its field is
    absent the value is null."""
    guard = f.get("ignore")
    if guard is None:
        return value()
    looked_at = guard["when"].get("field", source)
    test = predicate(guard["when"], scope, looked_at)
    if test is None:
        return F.lit(None)
    out = F.when(test, then(guard.get("then"), scope, looked_at, o)).otherwise(value())
    return scope.where_present(looked_at, out) if looked_at is not None and scope.has(looked_at) else out


def _source(f: dict, scope: Scope) -> tuple[Scope, str | None]:
    """Scope and name a field reads. ``from`` is one literal name; ``path`` (an extension) is dotted."""
    if "path" in f:
        *above, name = f["path"].split(".")
        return (scope.inside(".".join(above)) if above else scope) or Scope({}), name
    return scope, f.get("from")


def _own(spec: Spec) -> list[str]:
    return [f["name"] for f in spec.inline if f.get("type") != "extended_array"] + [f["name"] for f in (*spec.derived, *spec.constants)]


def _child(spec: Spec) -> dict | None:
    return next((f for f in spec.inline if f.get("type") == "extended_array"), None)


def output_names(spec: Spec) -> list[str]:
    """Output names of a specification, flattened children's after its own, each once."""
    child = _child(spec)
    return list(dict.fromkeys(_own(spec) + (output_names(Spec.parse(child)) if child else [])))


def _item(spec: dict, kind: T.DataType, o: Options) -> Callable[[Column], Column]:
    return lambda e: transform(spec, Scope({"item": (e, kind)}), "item", o)


def _inline(spec: Spec, scope: Scope, o: Options, spark: SparkSession) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for f in spec.inline:
        kind = f.get("type")
        if kind == "extended_array":
            continue
        at = scope.inside(f["object"]) if "object" in f else scope
        if at is None:
            out[f["name"]] = F.lit(None)
        elif kind == "array":
            name = f.get("from", f["name"])
            item = at.type(name).elementType if at.has(name) and isinstance(at.type(name), T.ArrayType) else None
            if item is None:
                out[f["name"]] = F.lit(None)
            elif isinstance(item, T.StructType):
                out[f["name"]] = _array(Spec.parse(f), at.col(name), item, o, spark)
            elif "item_transform" in f:
                each = F.transform(at.col(name), _item(f["item_transform"], item, o))
                out[f["name"]] = F.nullif(F.array_join(each, "; "), F.lit("")) if o.reasons else each
            else:
                raise ValueError(f"{f['name']}: an array of {item.simpleString()} needs item_transform")
        else:
            at, name = _source(f, at)
            value = _guarded(f, at, lambda f=f, at=at, name=name: transform(f["transform"], at, name, o), name, o)
            out[f["name"]] = value if at.there is None else F.when(at.there, value)
    return out


def fields_read(node) -> set[str]:
    """Names that a field's definition reads: under from, field, numerator and denominator, and a formula's names."""
    out: set[str] = set()
    if isinstance(node, dict):
        for k, v in node.items():
            if k in ("from", "field", "numerator", "denominator") and isinstance(v, str):
                out.add(v)
            elif k == "expression" and isinstance(v, str):
                out |= set(re.findall(r"[A-Za-z_]\w*", v))
            else:
                out |= fields_read(v)
    elif isinstance(node, (list, tuple)):
        for v in node:
            out |= fields_read(v)
    return out


def _waves(spec: Spec, o: Options) -> list[dict[str, Callable[[Scope], Column]]]:
    """Derived fields by dependency level: a field waits for the derived fields before it that it reads."""
    waves: list[dict] = []
    placed: dict[str, int] = {}
    for f in spec.derived:
        read = fields_read(f)
        wave = placed[f["name"]] = 1 + max([-1, *(w for n, w in placed.items() if n in read)])
        if wave == len(waves):
            waves.append({})
        waves[wave][f["name"]] = lambda s, f=f: _guarded(f, s, lambda: transform(f["transform"], s, f.get("from"), o), f.get("from"), o)
    return waves


def _constants(spec: Spec) -> dict[str, Column]:
    return {f["name"]: F.lit(f["value"]) for f in spec.constants}


def _array(spec: Spec, source: Column, element: T.StructType, o: Options, spark: SparkSession) -> Column:
    """``array``: every element through its own specification; with an extended_array inside, a list of flattened rows.

    Column types inside the lambda come from analysing the same expressions over an empty table of the element type.
    With Options.reasons the result is why elements do not convert, as one text.
    """
    quiet = replace(o, reasons=False, on_error="null") if o.reasons else o

    def steps(scope: Scope, typed: list[T.StructType] | None):
        """Values phase by phase; without ``typed`` the types are being found."""
        values = _inline(spec, scope, quiet, spark)
        yield values
        for i, wave in enumerate(_waves(spec, quiet)):
            types = typed[i] if typed else empty.select(*[c.alias(n) for n, c in values.items()]).schema
            found.append(types)
            values = values | {n: build(Scope({k: (c, types[k].dataType) for k, c in values.items()})) for n, build in wave.items()}
            yield values
        yield values | _constants(spec)

    def why(e: Column) -> Column:
        phases = list(steps(scope_of(e, element), typed))
        said = list(_inline(spec, scope_of(e, element), o, spark).items())
        for i, wave in enumerate(_waves(spec, o)):
            s = Scope({k: (c, typed[i][k].dataType) for k, c in phases[i].items()})
            said += [(n, build(s)) for n, build in wave.items()]
        if child is not None:
            inner = scope_of(e, element)
            kids = inner.col(child.get("from", child["name"]))
            said.append((child["name"], _array(Spec.parse(child), kids, inner.type(child.get("from", child["name"])).elementType, o, spark)))
        return F.array_join(F.array(*[F.concat(F.lit(f"{n}: "), c) for n, c in said]), "; ")

    empty, found = spark.createDataFrame([], f"e {'variant' if isinstance(element, Ragged) else element.simpleString()}"), []
    *_, values = steps(scope_of(F.col("e"), element), None)
    typed = list(found)

    def own(e: Column) -> Column:
        *_, values = steps(scope_of(e, element), typed)
        return F.struct(*[c.alias(n) for n, c in values.items()])

    child = _child(spec)
    if child is not None and not isinstance(element[child.get("from", child["name"])].dataType, T.ArrayType):
        child = None
    if o.reasons:
        return F.nullif(F.array_join(F.filter(F.transform(source, why), lambda x: x != ""), "; "), F.lit(""))
    if child is None:
        return F.transform(source, own)
    name = child.get("from", child["name"])
    kids_of = lambda e: F.coalesce(_array(Spec.parse(child), scope_of(e, element).col(name), element[name].dataType.elementType, o, spark), F.array())
    mine, kid_names = list(values), [n for n in output_names(Spec.parse(child)) if n not in values]
    pair = lambda p, k: F.struct(*[p.getField(n).alias(n) for n in mine], *[k.getField(n).alias(n) for n in kid_names])
    # a list of one null child stands for the parent's own row
    with_null = lambda kids: F.concat(F.transform(F.slice(F.concat(kids, F.array_repeat(F.get(kids, 0), 1)), 1, 1), lambda k: F.when(F.lit(False), k)), kids)
    return F.flatten(F.transform(source, lambda e: F.transform(with_null(kids_of(e)), lambda k: pair(own(e), k))))


def expand_dynamic(df: DataFrame, config: dict, scope: Scope, most: int = 1000) -> Spec:
    """A specification with its ``dynamic`` entries spelled out as inline fields.

    An entry (pattern, from_object, transform) gives a field for every key of the object that the pattern matches, named
    like the key, in the order of names. A struct's or a ragged record's keys are known; a map's are gathered in a pass
    over the records (their distinct keys), and more than ``most`` are refused.
    """
    entries = config.get("dynamic") or []
    more = []
    for entry in [entries] if isinstance(entries, dict) else entries:
        path, pattern = entry["from_object"], entry["pattern"]
        at = scope.inside(path)
        if isinstance(at, _MapScope):
            keys = df.select(F.explode(F.map_keys(at.c)).alias("key")).distinct()
            like = "^" + "".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in pattern) + "$"
            names = [r[0] for r in keys.where(F.col("key").rlike(like)).orderBy("key").limit(most + 1).collect()]
            if len(names) > most:
                raise ValueError(f"dynamic {pattern!r}: more than {most} keys")
        else:
            names = sorted(n for n in (at.names() if at else []) if fnmatch.fnmatchcase(n, pattern))
        more += [{"name": n, "from": n, "object": path, "transform": entry["transform"], **({"ignore": entry["ignore"]} if "ignore" in entry else {})} for n in names]
    inline = list(config.get("inline") or ())
    nested = [f for f in inline if f.get("type") == "extended_array"]
    return Spec.parse({**config, "inline": [f for f in inline if f not in nested] + more + nested})


def with_lookups(df: DataFrame, spec: Spec, scope: Scope) -> tuple[DataFrame, Spec]:
    """Large enums of the records' own inline fields joined; those inside arrays, cases and guards stay literals."""

    def source_of(f: dict) -> tuple[Column, T.DataType] | None:
        at = scope.inside(f["object"]) if "object" in f else scope
        at, name = _source(f, at) if at is not None else (None, None)
        return (at.col(name), at.type(name)) if at is not None and name is not None and at.has(name) else None

    df, inline = join_lookups(df, spec.inline, source_of)
    return df, replace(spec, inline=inline)


def _scope(df: DataFrame, record: str | None) -> Scope:
    if record is None:
        return Scope.of(df.schema, lambda n: F.col(f"`{n}`"))
    at = scope_of(F.col(f"`{record}`"), kind_of(df.schema[record]))
    if at is None:
        raise TypeError(f"{record!r} holds no objects; a VARIANT needs the type in its metadata that ragged_records gives")
    return at


def apply_spec(df: DataFrame, config: dict | Spec, options: Options = Options(), normalize_compat: bool = False, keep: tuple[str, ...] = (), record: str | None = None) -> DataFrame:
    """The records of ``df`` through a specification: inline, dynamic, derived, constants, then flattening.

    One column per output name, absent values null. A level of flattening is one generator: place 0 stands for the
    parent's own row, places from 1 for its children, so order and parents without children are kept. The parent's
    values win where names meet; with ``normalize_compat`` its empty places for child columns win too. ``keep`` names
    input columns carried along (an order column, say). ``record`` names a column of objects that are the records, a
    struct, map or VARIANT; else a row is the record. In a VARIANT or a map a key may be absent from some rows: there
    conditions on it do not hold, a guard gives null rather than its ``then``, and the value is null. Narrow: no
    shuffle, and no Python unless asked for by Options.exact or fuzzy dates. Enums with large tables are joined first
    (see lookups).
    """
    scope = _scope(df, record)
    df, spec = with_lookups(df, config if isinstance(config, Spec) else expand_dynamic(df, config, scope), scope)
    out = _level(df, spec, scope, options, list(keep), None)
    names = output_names(spec)
    if normalize_compat:
        out = out.withColumns({n: F.lit(None).cast(out.schema[n].dataType) for n in names if n not in _own(spec)})
    return out.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*keep, *names])])


def apply_apart(df: DataFrame, config: dict, options: Options = Options(), keep: tuple[str, ...] = (), record: str | None = None, errors: str = "errors") -> DataFrame:
    """apply_spec for records that may hold values which do not convert: those are null, and the column ``errors``, an
    array of (field, reason), tells of them; it is empty for a good row. One projection, one pass; a flattened row
    tells of its parents' values, too. See sinks.write_apart for the two outputs.
    """
    scope = _scope(df, record)
    df, spec = with_lookups(df, expand_dynamic(df, config, scope), scope)
    out = _level(df, spec, scope, replace(options, on_error="null"), list(keep), None, whys=True)
    said = [c for c in out.columns if c.startswith(_WHY)]
    pairs = F.array(*[F.struct(F.lit(c.removeprefix(_WHY)).alias("field"), F.col(f"`{c}`").alias("reason")) for c in said]) if said else F.array().cast("array<struct<field:string,reason:string>>")
    names = [F.col(f"`{n}`") for n in dict.fromkeys([*keep, *output_names(spec)])]
    return out.select(*names, F.filter(pairs, lambda e: e["reason"].isNotNull()).alias(errors))


def flat_map(df: DataFrame, name: str, inputs: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of a flat-map registered by register_flat_map over the columns ``inputs``, each with its row's ``keep``."""
    schema, fn = FLAT_MAPS[name]
    made, n = T.StructType.fromDDL(schema), len(inputs)

    def run(batches):
        for b in batches:
            out = fn(pa.RecordBatch.from_arrays(b.columns[:n], names=b.schema.names[:n]))
            yield pa.RecordBatch.from_arrays([*(c.take(out.column(0)) for c in b.columns[n:]), *out.columns[1:]], names=[*b.schema.names[n:], *out.schema.names[1:]])

    rows = df.select(*[F.col(f"`{c}`") for c in (*inputs, *keep)])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[n:], *made.fields]))


_WHY = "__why "


def _level(df: DataFrame, spec: Spec, scope: Scope, o: Options, carried: list[str], live: Column | None, whys: bool = False) -> DataFrame:
    """Add a level's columns; ``live`` tells rows that belong to it (all at the top), others get nulls."""
    only = lambda c: c if live is None else F.when(live, c)
    told = lambda said: {_WHY + n: only(c) for n, c in said.items()} if whys else {}
    asking = replace(o, reasons=True)
    child, spark = _child(spec), df.sparkSession
    inline = _inline(spec, scope, o, spark)
    why = told(_inline(spec, scope, asking, spark) if whys else {})
    hold = {}
    if child is not None and scope.has(name := child.get("from", child["name"])):
        kids, kind = scope.col(name), scope.type(name)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            hold, element = {"__kids": only(kids)}, kind.elementType
    taken = set(carried)
    marks = [c for c in df.columns if c.startswith("__at")]
    kept = [F.col(f"`{c}`") for c in dict.fromkeys([*carried, *marks])]
    out = df.select(*kept, *[only(c).alias(n) for n, c in inline.items() if n not in taken], *[c.alias(n) for n, c in (hold | why).items() if n not in taken])
    mine = [n for n in (*inline, *why) if n not in taken]
    for wave, asked in zip(_waves(spec, o), _waves(spec, asking), strict=True):
        s = Scope({n: (F.col(f"`{n}`"), out.schema[n].dataType) for n in (*inline, *(w for w in _own(spec) if w in out.columns)) if n in out.columns})
        new = {n: only(build(s)) for n, build in wave.items()} | told({n: build(s) for n, build in asked.items()} if whys else {})
        new = {n: c for n, c in new.items() if n not in taken}
        out = out.withColumns(new)
        mine += new
    new = {n: only(c) for n, c in _constants(spec).items() if n not in taken}
    out = out.withColumns(new) if new else out
    carried = list(dict.fromkeys([*carried, *mine, *new]))
    if child is None:
        return out
    inner = Spec.parse(child)
    if not hold:
        return out.withColumns({n: F.lit(None) for n in output_names(inner) if n not in carried})
    held = out.schema["__kids"].dataType
    at = f"__at{len(marks)}"
    first = F.array(F.lit(None).cast(held.elementType))
    spread = out.select("*", F.posexplode(F.concat(first, F.coalesce("__kids", F.array().cast(held)))).alias(at, "__kid")).drop("__kids")
    return _level(spread, inner, scope_of(F.col("__kid"), element), o, carried, F.col(at) > 0, whys)
