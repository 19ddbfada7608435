import csv
import io
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexiforge.operators import badrows

SCHEMA = "line_id long, file_id long, line_no long, raw_line string, reason string"


def brute(line):
    """A plain state machine for the reason of one line."""
    fields, cur, i, n, quoted_done = [], "", 0, len(line), False
    state = "start"  # start, plain, quoted, after
    for c in line:
        if state == "start":
            if c == '"' and not cur.strip():
                cur, state = "", "quoted"
            elif c == ",":
                fields.append(cur)
                cur = ""
            elif c == '"':
                return "quoting"
            else:
                cur += c
                state = "start" if not cur.strip() else "plain"
        elif state == "plain":
            if c == '"':
                return "quoting"
            if c == ",":
                fields.append(cur)
                cur, state = "", "start"
            else:
                cur += c
        elif state == "quoted":
            if c == '"':
                state = "after"
            else:
                cur += c
        elif state == "after":
            if c == '"' and not quoted_done:
                cur += '"'
                state = "quoted"
            elif c == ",":
                fields.append(cur)
                cur, state, quoted_done = "", "start", False
            elif c.isspace():
                quoted_done = True
            else:
                return "quoting"
    if state == "quoted":
        return "quoting"
    fields.append(cur)
    fields = [f.strip() for f in fields]
    if len(fields) != 5:
        return "column_count"
    k, v, c, co, d = fields
    ok = k and re.fullmatch("[0-9]*", v) and re.fullmatch(r"([0-9]+(\.[0-9]+)?)?", c) and re.fullmatch("([A-Z]{2})?", co)
    if ok and d:
        import datetime

        try:
            ok = bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", d)) and bool(datetime.date.fromisoformat(d))
        except ValueError:
            ok = False
    return None if ok else "invalid_value"


def reasons(spark, lines):
    df = spark.createDataFrame([(i, 1, i + 2, x, "clash") for i, x in enumerate(lines)], SCHEMA)
    got = {r.line_id: r.reason for r in badrows.rejected_rows(df).collect()}
    clean = {r.line_id for r in badrows.clean_rows(df).collect()}
    return got, clean


def test_reasons_match_a_state_machine(spark):
    rng = random.Random(4)
    parts = ['"', '""', ",", " ", "a", "12", "1.5", "US", "2024-02-29", "2023-02-29", '"x,y"', "\n", "kw", ""]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    lines += ['"a ""b"" c",1,2.5,US,2024-01-01', ' "a" , 1 ,2,US,', 'a,1,2,US,2024-13-01', 'k,1,5.,US,', 'k,١,1,US,', 'k,1,1,US,0000-01-01', '"a', 'a"b,1,2,US,', '"a"b,1,2,US,']
    lines = [x for x in lines if x.strip()]
    got, clean = reasons(spark, lines)
    for i, x in enumerate(lines):
        assert got.get(i) == brute(x), x
        assert (i in clean) == (brute(x) is None), x


def test_headers_blanks_nulls_and_long_lines(spark):
    long = "k" * 200_000
    rows = [(1, 1, 1, "keyword,volume", ""), (2, 1, 2, None, ""), (3, 1, 3, "   ", ""), (4, 1, 4, f"{long},1,2,US,", ""), (5, 1, 5, '"' + 'x""' * 50_000 + '",1,2,US,', "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert badrows.rejected_rows(df).collect() == []
    assert {r.line_id: len(r.keyword) for r in badrows.clean_rows(df).collect()} == {4: 200_000, 5: 100_000}
    assert badrows.rejected_rows(df.limit(0)).collect() == [] and badrows.clean_rows(df.limit(0)).collect() == []


def test_values_come_out_as_they_were_written(spark):
    long, longer = "9" * 20, "8" * 45
    rows = [(1, 1, 2, '"a\x01b,\x01a",1,2,US,', ""), (2, 1, 3, "a\x01b,,,,", ""), (3, 1, 4, f"k,{long},1,US,2024-02-29", ""), (4, 1, 5, f"k,{longer},1,US,", "")]
    got = {r.line_id: r for r in badrows.clean_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].keyword == "a\x01b,\x01a" and got[2].keyword == "a\x01b"
    assert str(got[3].volume) == long and got[3].volume_text is None and got[4].volume is None and got[4].volume_text == longer


field = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\r\x00"), max_size=8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.lists(field, min_size=1, max_size=7), min_size=80, max_size=120))
def test_written_records_are_never_faulty_in_quoting(spark, records):
    lines = []
    for r in records:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    got, _ = reasons(spark, lines)
    for i, (r, x) in enumerate(zip(records, lines)):
        if x.strip():
            assert got.get(i) == brute(x) and got.get(i) != "quoting"
            assert (got.get(i) == "column_count") == (len(r) != 5)


