"""Objects of array and concatenated files, cut anywhere, against a reader that goes through the text once."""

import json
import random

import pytest

from doctide.sources import readers


def serial(text, layout):
    """Objects and broken texts by one pass: texts between objects are told apart at opening braces."""
    good, broken, depth, quoted, i, start, gap, first = [], [], 0, False, 0, 0, 0, True

    def between(said, final):
        nonlocal first
        said = said.strip()
        if layout == "array":
            fine = said[:1] == "[" and said[-1:] == "]" and not said[1:-1].strip() if first and final else said == ("[" if first else "]" if final else ",")
        else:
            fine = said == "" or (said == "," and not first and not final)
        if not fine:
            broken.append(said)
        first = False

    while i < len(text):
        c = text[i]
        if c == "\\" and text[i + 1 : i + 2] not in ("", "{"):
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        elif c == "{":
            if quoted and not depth:
                between(text[gap:i], False)
                gap = i
            elif not quoted:
                if not depth:
                    between(text[gap:i], False)
                    start = i
                depth += 1
        elif c == "}" and not quoted and depth:
            depth -= 1
            if not depth:
                good.append(text[start : i + 1])
                gap = i + 1
        i += 1
    if depth:
        broken.append(text[start:])
    elif text:
        between(text[gap:], True)
    read = []
    for raw in good:
        try:
            json.loads(raw, parse_constant=lambda x: 1 / 0)
            read.append(raw)
        except (ValueError, ZeroDivisionError):
            broken.append(raw)
    return sorted(read), sorted(broken)


PARTS = ['{"a":1}', '{"b":{"c":["x",{}]}}', '{"s":"q{}\\"}{[\\\\"}', '{"é":"}{,"}', ",", ",", " ", "\n", "oops ", '"', "}", "{", "\\", "1", "[", "]", '{"n":NaN}', '{"cut":', '{"e":"\\u007b"}']


def text_of(rng, layout):
    if rng.random() < 0.5:
        docs = [rng.choice(PARTS[:4]) for _ in range(rng.randint(0, 8))]
        text = "[" + ", ".join(docs) + "]" if layout == "array" else rng.choice(["", "\n", ","]).join(docs)
        at = rng.randrange(len(text) + 1)
        return text if rng.random() < 0.5 else text[:at] + rng.choice(PARTS) + text[at:]
    return "".join(rng.choices(PARTS, k=rng.randint(1, 14)))


@pytest.mark.parametrize("layout", ["array", "concatenated"])
def test_files_cut_anywhere_equal_the_serial_reader(spark, tmp_path, layout):
    rng, texts = random.Random(layout), {}
    for k in range(150):
        texts[f"f{k}.json"] = text_of(rng, layout)
        (tmp_path / f"f{k}.json").write_text(texts[f"f{k}.json"], newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    wanted = sorted((raw, False) for t in texts.values() for raw in serial(t, layout)[0]) + sorted((raw, True) for t in texts.values() for raw in serial(t, layout)[1])
    try:
        for width in ("7", "23", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", width)
            got = readers.read_json_text(spark, str(tmp_path), layout).collect()
            # A broken object comes in parts, a range each, so broken texts are compared as one.
            good, bad = sorted(r["raw"] for r in got if not r["broken"]), sorted("".join(r["raw"] for r in got if r["broken"]))
            assert good == [raw for raw, broken in wanted if not broken]
            assert bad == sorted("".join(raw for raw, broken in wanted if broken))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    docs = [{"id": i, "text": "{\"}" * (i % 5), "in": {"deep": [i]}} for i in range(3000)]
    (folder / "one.json").write_text(json.dumps(docs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        out = readers.read_json_text(spark, str(folder / "one.json"), "array")
        from doctide.sources import json_split

        assert json_split.records(spark, str(folder / "one.json")).rdd.getNumPartitions() > 10
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert not any(r["broken"] for r in rows) and sorted((json.loads(r["raw"]) for r in rows), key=lambda d: d["id"]) == docs


def test_bytes_that_are_not_text_and_odd_ends(spark, tmp_path):
    for name, data in {"a": b'[{"a":"\xff"},{"b":1}]', "b": b"\xef\xbb\xbf[{\"c\":1}]", "c": b'[{"d":1},{', "d": b"", "e": b" \n", "f": b"[ ]"}.items():
        (tmp_path / name).write_bytes(data)
    rows = sorted((r["raw"], r["broken"]) for r in readers.read_json_text(spark, str(tmp_path), "array").collect())
    assert [raw for raw, broken in rows if not broken] == ['{"b":1}', '{"c":1}', '{"d":1}']
    assert sorted(raw for raw, broken in rows if broken) == ["", "{", '{"a":"\ufffd"}']


def test_a_range_is_cut_as_its_records_come(spark, tmp_path):
    """no range is held whole, by no group of its rows and by no task that cuts it."""
    (tmp_path / "one.json").write_text('[{"a":1},{"a":2}]')
    plan = readers.read_json_text(spark, str(tmp_path), "array")._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan

    import pyarrow as pa

    from doctide.sources import json_split

    taken = 0

    def batches():
        nonlocal taken
        for n in range(100):
            taken += 1
            rows = 1000 * [b'"a":1},']
            known = {"file": 0, "block": 0, "in_string": False, "depth": 0, "began": -1, "unclosed": -1, "last": False, "cut": False}
            yield pa.RecordBatch.from_pylist([known | {"body": b"[" if n == i == 0 else body} for i, body in enumerate(rows)])

    made = json_split._pieces("array", batches())
    assert next(made).num_rows > 0 and taken < 5
    assert sum(b.num_rows for b in made) > 90_000 and taken == 100


def test_every_writer_makes_a_whole_array():
    """partitions are written as arrays of their own, each led by an object."""
    import pyarrow as pa

    from doctide.plans.documents import _bracketed

    lines = lambda *texts: [x for b in _bracketed(iter([pa.record_batch({"value": list(texts)})]), '[{"o_orderkey":0}\n,') for x in b.column(0).to_pylist()]
    assert json.loads("\n".join(lines('{"a":1}', '{"a":2}'))) == [{"o_orderkey": 0}, {"a": 1}, {"a": 2}]
    assert json.loads("\n".join(lines())) == []
