import json
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions.numbers import order_key, order_key_of
from palimpsest.plans.filters import FilterError, compile_filter

# Fixed: numbers and strings at the boundaries of the filter format.
NUMBERS = ["0", "-0", "0.0", "1", "1.0", "10e-1", "-1", "5", "5.5", "1e2", "100", "79228162514264337593543950336", "79228162514264337593543950337", "1" + "0" * 40, "1e400", "-1e400", "1e-400", "-1e-400", "0.1", "0.10", "123456789.123456789"]


def fraction(text):
    mantissa, _, power = text.lower().partition("e")
    return Fraction(mantissa) * Fraction(10) ** int(power or 0)


def test_order_keys_sort_like_numbers():
    for a in NUMBERS:
        for b in NUMBERS:
            assert (order_key(a) < order_key(b)) == (fraction(a) < fraction(b)), (a, b)
            assert (order_key(a) == order_key(b)) == (fraction(a) == fraction(b)), (a, b)


number = st.from_regex(r"-?(0|[1-9][0-9]{0,20})(\.[0-9]{1,20})?(e[+-]?[0-9]{1,2})?", fullmatch=True)


@settings(max_examples=300, deadline=None)
@given(number, number)
def test_order_keys_of_any_numbers(a, b):
    assert (order_key(a) < order_key(b)) == (fraction(a) < fraction(b))
    assert (order_key(a) == order_key(b)) == (fraction(a) == fraction(b))


def test_order_key_of_huge_exponents():
    assert order_key("1e999999999999999999999") > order_key("9e999999999999999999998")
    assert order_key("-1e999999999999999999999") < order_key("-9e999999999999999999998")


def test_order_keys_of_a_column(spark):
    r = random.Random(6)
    some = ["-" * r.randint(0, 1) + str(r.randint(0, 10 ** r.randint(0, 30))) + ("." + "0" * r.randint(0, 5) + str(r.randint(0, 10**9))) * r.randint(0, 1) + (r.choice("eE") + r.choice(["", "+", "-"]) + "0" * r.randint(0, 2) + str(r.randint(0, 10 ** r.randint(0, 25)))) * r.randint(0, 1) for _ in range(2000)]
    texts = [*NUMBERS, "1e999999999999999999999", "9e999999999999999999998", "-1e-000", "00", *some]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", order_key_of(F.col("x")).alias("k")).collect()
    assert all(row["k"] == order_key(row["x"]) for row in got)
    assert spark.range(1).select(order_key_of(F.lit("x1")).alias("k")).first()["k"] is None


STRINGS = ["", "a", "a ", "A", "ab", "b", "5", "true", "null", "%", "_", "[a]", "'", "é", "￿", "\U0001f600", "x" * 4100]
VALUES = [json.dumps(s) for s in STRINGS] + NUMBERS + ["true", "false", "null", '["a", 5, true]', '["A"]', "[]", '{"z": 1}', "{}"]


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(i, '{"k": ' + v + "}") for i, v in enumerate(VALUES)] + [(len(VALUES), "{}"), (len(VALUES) + 1, None), (len(VALUES) + 2, '{"k.z": 1}')]
    return spark.createDataFrame(rows, "i int, metadata string").cache()


def utf16(x):
    return x.encode("utf-16-be", "surrogatepass")


class Number(str):
    pass


def loads(text):
    return json.loads(text, parse_int=Number, parse_float=Number) if text else {}


def same(stored_value, operand):
    if isinstance(operand, bool) or isinstance(stored_value, bool):
        return stored_value is operand
    if isinstance(operand, Number) or isinstance(stored_value, Number):
        return isinstance(operand, Number) and isinstance(stored_value, Number) and fraction(operand) == fraction(stored_value)
    return isinstance(stored_value, str) and stored_value == operand


def expected(op, operand):
    out = set()
    for i, text in enumerate([*('{"k": ' + v + "}" for v in VALUES), "{}", None, '{"k.z": 1}']):
        value = loads(text).get("k")
        if op in ("gt", "gte", "lt", "lte"):
            hit = False
            if isinstance(operand, Number) and isinstance(value, Number):
                a, b = fraction(value), fraction(operand)
            elif type(operand) is str and type(value) is str:
                a, b = utf16(value), utf16(operand)
            else:
                continue
            hit = {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]
        elif op == "eq":
            hit = same(value, operand)
        elif op == "ne":
            hit = not same(value, operand)
        elif op == "contains":
            hit = (type(value) is str and operand in value) or (isinstance(value, list) and any(type(x) is str and x == operand for x in value))
        elif op == "list":
            hit = isinstance(value, list) and any(same(x, operand) for x in value)
        if hit:
            out.add(i)
    return out


def test_metadata_operators_against_plain_python(stored):
    cases = []
    for text in ['"a"', '"A"', '"5"', '""', '"\\uffff"', "5", "1.0", "1e400", "0", "true", "-1"]:
        operand = loads('{"k": ' + text + "}")["k"]
        ops = ["eq", "ne", "list"] + (["gt", "gte", "lt", "lte"] if not isinstance(operand, bool) else []) + (["contains"] if type(operand) is str else [])
        for op in ops:
            body = {"eq": text, "list": f"[{text}]"}.get(op, f'{{"{op}": {text}}}')
            cases.append((op, operand, f'{{"metadata": {{"k": {body}}}}}'))
    columns = [compile_filter(c[2], "message").alias(f"c{n}") for n, c in enumerate(cases)]
    got = stored.select("i", *columns).collect()
    for n, (op, operand, text) in enumerate(cases):
        assert {r["i"] for r in got if r[f"c{n}"]} == expected(op, operand), text


def ids(stored, request):
    return {r["i"] for r in stored.where(compile_filter(request, "message")).collect()}


def test_metadata_set_unset_and_paths(stored):
    n = len(VALUES)
    unset = {VALUES.index("null"), n, n + 1, n + 2}
    assert ids(stored, '{"metadata": {"k": null}}') == unset
    assert ids(stored, '{"metadata": {"k": "*"}}') == set(range(n + 3)) - unset
    assert ids(stored, '{"metadata": {"k": {"ne": null}}}') == set(range(n + 3)) - unset
    assert ids(stored, '{"metadata": {"k": {"z": 1.0}}}') == {VALUES.index('{"z": 1}')}
    assert ids(stored, '{"metadata": {"k.z": 1}}') == {n + 2}
    assert ids(stored, '{"metadata": {"k": {"in": ["a", null]}}}') == {VALUES.index('"a"')} | unset
    assert ids(stored, '{"metadata": {"k": {"in": []}}}') == set()
    assert ids(stored, '{"metadata": {"k": {"icontains": "A"}}}') >= {VALUES.index('["A"]'), VALUES.index('["a", 5, true]'), VALUES.index('"ab"')}
    assert ids(stored, '{"metadata": null}') == set()
    assert ids(stored, '{"metadata": "*"}') == set(range(n + 3))


@pytest.mark.parametrize("request_text", [
    "[1]", "{", '{"a": 1, "a": 2}', '{"OR": {}}', '{"AND": [1]}', '{"peer_id": 5}', '{"peer_id": {}}', '{"peer_id": {"gt": "a"}}', '{"peer_id": {"eq": "a"}}', '{"peer_id": {"contains": null}}',
    '{"peer_id": {"in": "a"}}', '{"token_count": 1.5}', '{"token_count": "1.0"}', '{"token_count": {"contains": "1"}}', '{"token_count": true}', '{"created_at": "yesterday"}', '{"created_at": "2024-13-01"}', '{"created_at": "2024-01-01 10:00"}',
    '{"metadata": []}', '{"metadata": {"gt": 1}}', '{"metadata": {"k": []}}', '{"metadata": {"k": {}}}', '{"metadata": {"k": {"gt": 1, "z": 2}}}', '{"metadata": {"k": [[1]]}}', '{"metadata": {"k": {"gt": true}}}', '{"metadata": {"contains": 1}}', '{"x": "\\ud800"}',
    '{"peer_id": ' + json.dumps(["a"] * 1001) + "}", '{"x": ' + "[" * 70 + "]" * 70 + "}",
])
def test_malformed_filters_are_rejected(spark, request_text):
    with pytest.raises(FilterError):
        compile_filter(request_text, "message")


@pytest.mark.parametrize("request_text", [None, "", "  ", "null", "{}", '{"unknown": {"gt": []}}', '{"AND": []}', '{"NOT": []}', '{"peer_id": "*"}', '{"peer_id": ["a", "*"]}'])
def test_filters_that_match_all(spark, request_text):
    rows = spark.createDataFrame([(None,), ("a",)], "peer string")
    assert rows.where(compile_filter(request_text, "message")).count() == 2


def test_unset_values_match_only_negatives(spark):
    rows = spark.createDataFrame([(None,), ("a",), ("b",)], "peer string")
    find = lambda r: sorted(str(x[0]) for x in rows.where(compile_filter(r, "message")).collect())
    assert find('{"peer_id": "a"}') == ["a"]
    assert find('{"peer_id": {"ne": "a"}}') == ["None", "b"]
    assert find('{"NOT": [{"peer_id": "a"}]}') == ["None", "b"]
    assert find('{"peer_id": null}') == ["None"]
    assert find('{"peer_id": {"ne": null}}') == ["a", "b"]
    assert find('{"peer_id": ["b", null]}') == ["None", "b"]
    assert find('{"peer_id": []}') == []
    assert find('{"peer_id": {"contains": ""}}') == ["a", "b"]


def test_counts_and_times_beyond_what_is_stored(spark):
    rows = spark.sql("SELECT 5 AS token_count, timestamp_ntz'2024-01-01 00:00:00.000001' AS created_at")
    match = lambda r: rows.where(compile_filter(r, "message")).count() == 1
    assert match('{"token_count": 5.0}') and match('{"token_count": "+5"}') and match('{"token_count": 50e-1}')
    assert match('{"token_count": {"lt": 1e40}}') and not match('{"token_count": {"gt": 1e40}}') and match('{"token_count": {"ne": 1e40}}')
    assert match('{"token_count": {"gt": -1e400}}') and not match('{"token_count": 1e40}') and not match('{"token_count": [1e40]}')
    assert match('{"created_at": "2024-01-01T00:00:00.000001Z"}') and match('{"created_at": {"gt": "2024-01-01T02:00:00+02:00"}}')
    assert not match('{"created_at": "2024-01-01T00:00:00.0000015"}') and match('{"created_at": {"lt": "2024-01-01T00:00:00.0000015"}}')
    assert match('{"created_at": {"gt": "2024-01-01T00:00:00.0000005"}}') and not match('{"created_at": {"gte": "2024-01-01T00:00:00.0000015"}}')


def test_session_members_are_existential(spark):
    rows = spark.createDataFrame([("s1", [("a", True), ("b", False)]), ("s2", [("b", True)]), ("s3", [])], "name string, members array<struct<peer:string,active:boolean>>")
    find = lambda r: sorted(x["name"] for x in rows.where(compile_filter(r, "session")).collect())
    assert find('{"peer_id": "b"}') == ["s2"]
    assert find('{"peer_id": {"ne": "b"}}') == ["s1", "s3"]
    assert find('{"peer_id": null}') == ["s3"]
    assert find('{"peer_id": {"ne": null}}') == ["s1", "s2"]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(10).select(F.col("id").cast("string").alias("peer"), F.col("id").alias("token_count"), F.lit("x").alias("content")).write.parquet(path)
    rows = spark.read.parquet(path).where(compile_filter('{"peer_id": "3", "token_count": {"gte": 2}}', "message")).select("peer")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(peer,3)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_numbers_of_any_size_against_fractions(spark):
    r = random.Random(8)
    texts = [*NUMBERS, "1e-19", "-1e-19", "0.000000000000000001", "-0.00000000000000001", "9999999999999999999", "10000000000000000000", "99999999999999999", "1e19", "1e18", "12345678901234567", "1234567890.1234567", "-1e999999999", "1e-999999999", "0.1234567890123456789"]
    texts += [f"{r.choice(['', '-'])}{r.randint(0, 10 ** r.randint(0, 22))}" + ("" if r.random() < 0.5 else f".{r.randint(0, 10 ** r.randint(1, 22))}") for _ in range(60)]
    frame = spark.createDataFrame([(i, f'{{"k": {x}}}') for i, x in enumerate(texts)], "i int, metadata string").cache()
    exact = [None if "e9999" in x or "e-9999" in x else fraction(x) for x in texts]
    asked = [i for i in range(len(texts)) if exact[i] is not None][::7] + [i for i in range(len(NUMBERS), len(NUMBERS) + 14) if exact[i] is not None][::2]
    columns = [compile_filter(f'{{"metadata": {{"k": {{"{op}": {texts[j]}}}}}}}', "message").alias(f"c{j}_{op}") for j in dict.fromkeys(asked) for op in ("gt", "gte", "lt", "lte")]
    columns += [compile_filter(f'{{"metadata": {{"k": {{"in": [{texts[j]}, "x"]}}}}}}', "message").alias(f"c{j}_in") for j in dict.fromkeys(asked)]
    tests = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "in": lambda a, b: a == b}
    for row in frame.select("i", *columns).collect():
        if exact[row["i"]] is not None:
            for j in dict.fromkeys(asked):
                for op, test in tests.items():
                    assert row[f"c{j}_{op}"] == test(exact[row["i"]], exact[j]), (op, texts[row["i"]], texts[j])
    for op, hit in (("lt", True), ("gt", False)):
        assert frame.where(compile_filter(f'{{"metadata": {{"k": {{"{op}": 1e999999999}}}}}}', "message")).count() == (len(texts) if hit else 0)


def test_strings_and_keys_of_any_characters(spark):
    """Quotes, backslashes, control characters and numbers inside strings, at several depths."""
    odd = ['"', "\\", '\\"', "\\\\\"x\\", "\x01", "\x01 5", "5", "a\x01", '{"k": 1}', "[1]", "n\\n", "\n", "é\U0001f600", "-1e5", "true", 'x"y": 2, "z', "\\u0022", "/"]
    rows = [(i, json.dumps({"a": {x: [x, 1, {"b": x}], "v": x}, x: x}, ensure_ascii=i % 2 == 0)) for i, x in enumerate(odd)]
    frame = spark.createDataFrame(rows, "i int, metadata string").cache()
    columns = []
    for i, x in enumerate(odd):
        q = json.dumps(x)
        columns += [compile_filter(f'{{"metadata": {body}}}', "message").alias(f"c{i}_{k}") for k, body in enumerate((f'{{"a": {{"v": {q}}}}}', f"{{{q}: {q}}}" if x else "{}", f'{{"a": {{{q}: [{q}, 1.0]}}}}', f'{{"a": {{"v": {{"contains": {q}}}}}}}', f'{{"a": {{"v": {{"gt": {q}}}}}}}'))]
    got = frame.select("i", *columns).collect()
    for i, x in enumerate(odd):
        sets = [{r["i"] for r in got if r[f"c{i}_{k}"]} for k in range(5)]
        assert sets[:3] == [{i}] * 3, x
        assert sets[3] == {j for j, y in enumerate(odd) if x in y} and sets[4] == {j for j, y in enumerate(odd) if utf16(y) > utf16(x)}, x


def test_strict_metadata(spark):
    from palimpsest.plans.metadata import is_strict

    texts = {"{}": True, ' {"k": [1, {"z": null}]} ': True, "": True, " ": True, None: True, "[]": False, "1": False, '"x"': False, "{": False, '{"k": 1, "k": 2}': False, '{"k": 01}': False, '{"k": NaN}': False, '{"k": "{[{[{["}': True, '{"k":' * 64 + "1" + "}" * 64: True, '{"k":' * 65 + "1" + "}" * 65: False, '{"k": "a\\"b{"}': True}
    got = spark.createDataFrame([(k,) for k in texts], "t string").select("t", is_strict(F.col("t")).alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in got} == texts
