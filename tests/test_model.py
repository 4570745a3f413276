"""Random statements against a plain Python model of the semantics."""

from dataclasses import dataclass

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.functions.codecs import parse_schema
from tidemark.plans.ast import Combine, Condition, Logic, Select, TableRef
from tidemark.session import Engine

SCHEMAS = {"a": "k(STRING),n(INT),s(STRING)", "b": "k(STRING),s(STRING),t(STRING)"}
TYPES = {"k": str, "n": int, "s": str, "t": str}
texts = st.sampled_from(["", "a", "b", "aa", "ab", "abc"])
rows = {"a": st.lists(st.tuples(texts, st.integers(-2, 2), texts), max_size=6), "b": st.lists(st.tuples(texts, texts, texts), max_size=6)}


@dataclass
class Row:
    key: str
    order: tuple
    cells: dict


def shortlex(value):
    return (len(value), value) if isinstance(value, str) else (0, value)


def holds(p, cells, types=TYPES):
    if isinstance(p, Logic):
        left, right = holds(p.left, cells, types), holds(p.right, cells, types)
        if p.op == "AND":
            return False if False in (left, right) else None if None in (left, right) else True
        return True if True in (left, right) else None if None in (left, right) else False
    cell = cells.get(p.field)
    if cell is None:
        return None
    values = [types[p.field](v) for v in p.values]
    found = {"=": lambda: cell == values[0], ">": lambda: shortlex(cell) > shortlex(values[0]), "<": lambda: shortlex(cell) < shortlex(values[0]), "IN": lambda: cell in values,
             "CONTAINS": lambda: str(p.values[0]) != "" and p.values[0] in str(cell)}[p.op]()
    return found is not p.negated


def evaluate(node, tables, schemas=SCHEMAS, types=TYPES):
    """(field names, rows) in the model."""
    if isinstance(node, Select):
        if isinstance(node.source, TableRef):
            names = [f.name for f in parse_schema(schemas[node.source.name])]
            found = [Row(r[0], tuple(map(shortlex, r)), dict(zip(names, r))) for r in tables[node.source.name]]
        else:
            names, found = evaluate(node.source, tables, schemas, types)
        found = [r for r in found if node.where is None or holds(node.where, r.cells, types) is True]
        wanted = list(dict.fromkeys([f for f in node.fields if f != "*"] + (names if "*" in node.fields else [])))
        return wanted, [Row(r.key, r.order, {n: r.cells.get(n) for n in wanted}) for r in found]
    (left_names, left), (right_names, right) = evaluate(node.left, tables, schemas, types), evaluate(node.right, tables, schemas, types)
    names = left_names + [n for n in right_names if n not in left_names]
    if node.op == "JOIN":
        first = {}
        for r in sorted(left, key=lambda r: r.order):
            first.setdefault(r.key, r)
        return names, [Row(r.key, r.order, r.cells | first[r.key].cells) for r in right if r.key in first]
    if node.op == "INTERSECTION":
        both = {r.key for r in left} & {r.key for r in right}
        left, right = ([r for r in side if r.key in both] for side in (left, right))
    united = [Row(r.key, ((0, side), *r.order), {n: r.cells.get(n) for n in names}) for side, rs in (("0", left), ("1", right)) for r in rs]
    return names, united


def conditions(names):
    value = lambda n: st.sampled_from(["-1", "0", "1"]) if n == "n" else texts
    one = lambda n, o: st.builds(lambda v, neg: Condition(n, o, tuple(v), neg), st.lists(value(n), min_size=1, max_size=2 if o == "IN" else 1), st.booleans())
    single = st.tuples(st.sampled_from(names), st.sampled_from(["=", "<", ">", "IN", "CONTAINS"])).flatmap(lambda x: one(*x))
    return single | st.builds(Logic, st.sampled_from(["AND", "OR"]), single, single) | st.builds(lambda o, a, p, b, c: Logic(o, a, Logic(p, b, c)), st.sampled_from(["AND", "OR"]), single, st.sampled_from(["AND", "OR"]), single, single)


def scan(name):
    names = [f.name for f in parse_schema(SCHEMAS[name])]
    fields = st.lists(st.sampled_from([*names, "*"]), min_size=1, max_size=3).map(tuple)
    return st.builds(Select, fields, st.just(TableRef("m", name)), st.none() | conditions(names))


scans = scan("a") | scan("b")
combined = st.builds(Combine, st.sampled_from(["JOIN", "UNION", "INTERSECTION"]), scans, scans)
statements = scans | combined | st.builds(Combine, st.sampled_from(["JOIN", "UNION", "INTERSECTION"]), scans, combined) | st.builds(Combine, st.sampled_from(["JOIN", "UNION"]), combined, scans) | st.builds(lambda s: Select(("*",), s), combined)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(statements, st.fixed_dictionaries(rows))
def test_lowering_agrees_with_the_model(spark, statement, tables):
    engine = Engine(spark)
    for name, content in tables.items():
        engine.register(f"m.{name}", spark.createDataFrame(content, "k string, n int, s string" if name == "a" else "k string, s string, t string"), parse_schema(SCHEMAS[name]))
    names, expected = evaluate(statement, tables)
    frame = engine.frame(str(statement))
    assert frame.names == names
    plain = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(plain, frame.output().collect())) == sorted(plain(r.cells[n] for n in names) for r in expected)
    assert frame.counted().first()[0] == len(expected)
    ordered = [plain(r) for r in frame.output(ordered=True).collect()]
    assert ordered == [plain(r.cells[n] for n in names) for r in sorted(expected, key=lambda r: (shortlex(r.key), r.order))] or len({(r.key, r.order) for r in expected}) < len(expected)
