"""The statement model compiled to Spark expressions: parsed JSON is checked and put in order within the plan, no Python beside it.

Each class becomes one expression over a VARIANT, made from its fields; classes in it are expanded in place, lists become `transform`.
What a name stands for is bound by a lambda of its own, as an expression that is named twice would be computed twice. Whole numbers are
those of 38 digits.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import WHITE
from lexloom.operators.validate import ID_PREFIX, MODEL, Field, Model

NO_ERRORS = "CAST(array() AS array<string>)"


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: As a literal of Spark SQL.
_WHITE = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITE) + "'"


def _strip(x: str) -> str:
    return f"btrim({x}, {_WHITE})"


class Compiler:
    """Writes the expressions of one model."""

    def __init__(self, model: Model):
        self.model, self.names = model, (f"v{i}" for i in count())

    def let(self, value: str, body) -> str:
        name = next(self.names)
        return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"

    def kind(self, f: Field) -> str:
        plain = {"str": "string", "int": "bigint"}.get(f.kind) or ("string" if f.kind in self.model.enums else self.model.ddl(f.kind))
        return f"array<{plain}>" if f.many else plain

    def pair(self, value: str, errors: str) -> str:
        return f"named_struct('v', {value}, 'e', {errors})"

    def wrong(self, kind: str, at: str, what: str) -> str:
        return self.pair(f"CAST(NULL AS {kind})", f"array(concat({at}, {quoted(': ' + what)}))")

    def value(self, kind: str, x: str, at: str, seed: str) -> str:
        """(v, e) of one value that is there; x is a VARIANT."""
        if kind in self.model.classes:
            return self.of_class(kind, x, at, seed)
        shape = f"schema_of_variant({x})"
        if kind == "int":
            text = _strip(f"try_variant_get({x}, '$', 'string')")
            number = (
                f"CASE WHEN {shape} = 'BOOLEAN' THEN CAST(try_variant_get({x}, '$', 'boolean') AS bigint) WHEN {shape} = 'BIGINT' THEN try_variant_get({x}, '$', 'bigint') "
                f"WHEN {shape} = 'DOUBLE' THEN IF(try_variant_get({x}, '$', 'double') = floor(try_variant_get({x}, '$', 'double')), try_cast(try_variant_get({x}, '$', 'double') AS bigint), NULL) "
                f"WHEN {shape} LIKE 'DECIMAL%' THEN IF(try_variant_get({x}, '$', 'decimal(38,18)') = floor(try_variant_get({x}, '$', 'decimal(38,18)')), try_cast(try_variant_get({x}, '$', 'decimal(38,18)') AS bigint), NULL) "
                rf"WHEN {shape} = 'STRING' AND {text} RLIKE r'^[+-]?[0-9]+(_[0-9]+)*$' THEN try_cast(replace({text}, '_', '') AS bigint) END"
            )
            return self.let(number, lambda n: f"IF({n} IS NULL, {self.wrong('bigint', at, 'not a whole number')}, {self.pair(n, NO_ERRORS)})")
        wrong = self.wrong("string", at, "not a string")
        text = f"try_variant_get({x}, '$', 'string')"
        if kind in self.model.enums:
            values = self.model.enums[kind]
            known = f"IF({text} IN ({', '.join(map(quoted, values))}), {self.pair(text, NO_ERRORS)}, {self.wrong('string', at, 'not one of ' + ', '.join(values))})"
            return f"IF({shape} = 'STRING', {known}, {wrong})"
        return f"IF({shape} = 'STRING', {self.pair(_strip(text), NO_ERRORS)}, {wrong})"

    def field(self, name: str, f: Field, x: str, at: str, seed: str, first: bool) -> str:
        """(v, e) of a field of the object x, there or not."""
        kind = self.kind(f)
        here = f"concat({at}, IF({at} = '', '', '.'), {quoted(f.name)})"
        got = f"try_variant_get({x}, {quoted('$.' + f.name)}, 'variant')"
        if f.other and f.other != f.name:
            got = f"coalesce({got}, try_variant_get({x}, {quoted('$.' + f.other)}, 'variant'))"
        if f.many:
            default = f"CAST(array() AS {kind})"
        elif f.nullable:
            default = f"CAST(NULL AS {kind})"
        elif first and f.name.endswith("Id"):
            prefix = ID_PREFIX.get(name, name[:3].lower())
            default = f"concat({quoted(prefix + '_')}, substring(sha1(concat({seed}, {quoted('|' + name)}, IF({at} = '', '', '|'), translate({at}, '.', '|'))), 1, 8))"
        else:
            default = "''" if kind == "string" else f"CAST(NULL AS {kind})"
        absent = self.wrong(kind, here, "missing") if f.required else self.pair(default, NO_ERRORS)

        def there(v: str) -> str:
            if not f.many:
                return self.value(f.kind, v, here, seed)
            item, i = next(self.names), next(self.names)
            each = self.value(f.kind, item, f"concat({here}, '.', CAST({i} AS string))", seed)
            rows = f"transform(CAST({v} AS array<variant>), ({item}, {i}) -> {each})"
            few = f"IF(size({v}_) < {f.least}, array(concat({here}, {quoted(f': at least {f.least} needed')})), {NO_ERRORS})" if f.least else NO_ERRORS
            listed = self.let(rows, lambda r: self.pair(f"transform({r}, {r}e -> {r}e.v)", f"concat({few.replace(v + '_', r)}, flatten(transform({r}, {r}e -> {r}e.e)))"))
            return f"IF(schema_of_variant({v}) LIKE 'ARRAY%', {listed}, {self.wrong(kind, here, 'not a list')})"

        null = f"WHEN is_variant_null({{v}}) THEN {self.pair(f'CAST(NULL AS {kind})', NO_ERRORS)}" if f.nullable else ""
        return self.let(got, lambda v: f"CASE WHEN {v} IS NULL THEN {absent} {null.format(v=v)} ELSE {there(v)} END")

    def of_class(self, name: str, x: str, at: str, seed: str) -> str:
        fields = self.model.fields(name)
        parts = ", ".join(f"'f{i}', {self.field(name, f, x, at, seed, i == 0)}" for i, f in enumerate(fields))

        def put(r: str) -> str:
            value = "named_struct(" + ", ".join(f"{quoted(f.name)}, {r}.f{i}.v" for i, f in enumerate(fields)) + ")"
            errors = [f"{r}.f{i}.e" for i in range(len(fields))]
            for condition, where, what in self.model.rules.get(name, ()):
                tested = condition.format(**{f.name: f"{r}.f{i}.v" for i, f in enumerate(fields)})
                errors.append(f"IF(coalesce({tested}, false), array(concat({at}, IF({at} = '', '', '.'), {quoted(f'{where}: {what}')})), {NO_ERRORS})")
            return self.pair(value, f"concat({', '.join(errors)})")

        whole = self.let(f"named_struct({parts})", put)
        none = self.pair(f"CAST(NULL AS {self.model.ddl(name)})", f"array(concat(IF({at} = '', {quoted(name)}, {at}), ': not an object'))")
        return f"IF(coalesce(schema_of_variant({x}) LIKE 'OBJECT%', false), {whole}, {none})"

    def document(self, name: str, raw: str, seed: str) -> str:
        """(normal, errors) of JSON text: what stands behind the first value of a text is found by putting the text into a list and into
        an object."""
        parsed = f"IF(try_parse_json(concat('[', {raw}, ']')) IS NULL OR try_parse_json(concat('{{\"x\":', {raw}, '}}')) IS NULL OR btrim({raw}, ' \\t\\r\\n') = '', NULL, try_parse_json({raw}))"

        def judged(v: str) -> str:
            done = self.let(self.of_class(name, v, "''", seed), lambda r: f"named_struct('normal', IF(size({r}.e) = 0, to_json({r}.v, map('ignoreNullFields', 'false')), NULL), 'errors', {r}.e)")
            return f"IF({v} IS NULL, named_struct('normal', CAST(NULL AS string), 'errors', array({quoted(name + ': not JSON')})), {done})"

        return self.let(parsed, judged)


def checked(concept: str, raw: str, names: list[str] | None = None, model: Model = MODEL, seed: str | None = None) -> Column:
    """(normal, errors) of the JSON in column `raw`, of the class that column `concept` names."""
    c = Compiler(model)
    text, given = f"coalesce(`{raw}`, '')", f"coalesce(`{seed}`, '')" if seed else f"coalesce(`{raw}`, '')"
    cases = " ".join(f"WHEN {quoted(n)} THEN {c.document(n, text, given)}" for n in names or model.classes)
    return F.expr(f"CASE `{concept}` {cases} ELSE named_struct('normal', CAST(NULL AS string), 'errors', array(concat(coalesce(`{concept}`, 'null'), ': unknown class'))) END")


def validate(df: DataFrame, concept: str = "concept", raw: str = "json_str", names: list[str] | None = None, model: Model = MODEL) -> DataFrame:
    """df with `valid`, `normal` (JSON with all fields by their first names) and `errors`; `names` are the classes to look for, if not all.

    The rules are those of `validate_json`. JSON with a key twice in one object is no JSON here, nor is
    NaN. Null and empty texts are no JSON.
    """
    out = df.withColumn("_checked", checked(concept, raw, names, model))
    return out.select(*df.columns, (F.size("_checked.errors") == 0).alias("valid"), "_checked.normal", "_checked.errors")
