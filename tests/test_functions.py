"""Column functions against plain Python."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, dates, display, maps, maths, patterns, registry, strings, versions
from millrace.operators import filters, projections, report, sets
from millrace.operators.aggregates import column_widths, distinct_values, outputs_by_host, shape

# Texts with the cells of the whole text and of its widest line.
WIDTHS = {
    "": (0, 0),
    " ": (1, 1),
    "plain text": (10, 10),
    "Gr\u00fc\u00dfe": (5, 5),
    "e\u0303e\u0301combined": (10, 10),
    "\u6f22\u5b57\u304b\u306a\u30ab\u30ca": (12, 12),
    "\ud55c\uad6d\uc5b4": (6, 6),
    "\uff26\uff35\uff2c\uff2c": (8, 8),
    "\u3001\u3002\u300c\u300d": (8, 8),
    "\u3099\u309a": (0, 0),
    "a\tb": (3, 3),
    "\x08back\x7f": (2, 2),
    "\x00nul\x1f": (3, 3),
    "\x1b[1;31mred\x1b[0m": (3, 3),
    "mixed \u6f22 and \u00e9": (14, 14),
    "emoji \U0001f600 x": (9, 9),
    "line one\nlonger line two\n": (25, 15),
}


def apply(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.out for r in df.select("i", build(F.col("v")).alias("out")).collect()}
    return [got[i] for i in range(len(values))]


def test_width(spark):
    texts = list(WIDTHS)
    assert apply(spark, texts, display.line_width) == [WIDTHS[t][0] for t in texts]
    assert apply(spark, texts, display.display_width) == [WIDTHS[t][1] for t in texts]


@pytest.mark.parametrize(
    "align,width,expected",
    [
        ("l", 6, ["      ", "a     ", "ab    ", "abc   ", "\u6f22    ", "\u6f22a   ", "too long"]),
        ("r", 6, ["      ", "     a", "    ab", "   abc", "    \u6f22", "   \u6f22a", "too long"]),
        ("c", 6, ["      ", "  a   ", "  ab  ", " abc  ", "  \u6f22  ", " \u6f22a  ", "too long"]),
        ("c", 5, ["     ", "  a  ", "  ab ", " abc ", "  \u6f22 ", " \u6f22a ", "too long"]),
    ],
)
def test_justify(spark, align, width, expected):
    values = ["", "a", "ab", "abc", "\u6f22", "\u6f22a", "too long"]
    assert apply(spark, values, lambda c: display.justify(c, F.lit(width), align)) == expected


def test_unknown_alignment(spark):
    with pytest.raises(ValueError):
        display.justify(F.lit("x"), F.lit(1), "x")


@pytest.mark.parametrize("width", [1, 3, 5, 8, 13])
def test_wrap(spark, width):
    values = [
        "the quick brown fox jumps", "incomprehensibilities", "a incomprehensibilities b", "abcd efg",
        "one  two   three four", "x", "ab cdefghijklmnop qr", "12345 1234567890123 1", "  lead in",
        "a      b      c", "tail     ", "abc   defghijklmnopqrs   t",
    ]
    # Leading blanks that alone fill a line come out as a blank line in Python, here they go.
    values = [v for v in values if width > 1 or not v.startswith(" ")]
    got = apply(spark, values, lambda c: display.wrap(c, F.lit(width)))
    plain = textwrap.TextWrapper(width=width, break_on_hyphens=False)
    for value, lines in zip(values, got):
        if len(value) <= width:
            assert lines == [value]
        else:
            assert lines == plain.wrap(value)


def test_case_styles(spark):
    values = ["ring-x", "they're HERE", "", "ÉCOLE été", "a1b c"]
    assert apply(spark, values, strings.title) == [v.title() for v in values]
    assert apply(spark, values, strings.capitalize) == [v.capitalize() for v in values]
    assert apply(spark, ["aB"], lambda c: strings.header_style(c, "upper")) == ["AB"]
    assert apply(spark, ["aB"], lambda c: strings.header_style(c, None)) == ["aB"]
    with pytest.raises(ValueError):
        strings.header_style(F.lit("x"), "odd")


def test_strip_and_words(spark):
    values = ["\t a b \n", "", "  ", "x"]
    assert apply(spark, values, strings.strip) == [v.strip() for v in values]
    assert apply(spark, values, strings.words) == [v.split() for v in values]


def test_file_parts(spark):
    values = ["/a/b/c.tar.gz", "noext", "/a.b/.hidden", "x.json"]
    assert apply(spark, values, strings.file_name) == ["c.tar.gz", "noext", ".hidden", "x.json"]
    assert apply(spark, values, strings.file_stem) == ["c.tar", "noext", ".hidden", "x"]
    assert apply(spark, values, strings.file_extension) == ["gz", "", "", "json"]
    got = apply(spark, ["app://x/y", "plain"], lambda c: F.concat_ws("|", *strings.split_scheme(c)))
    assert got == ["app|x/y", "image|plain"]


def test_short_ids(spark, rows):
    ids = apply(spark, [str(i) for i in range(500)], lambda c: strings.short_id("sa-", c))
    assert len(set(ids)) == 500 and all(re.fullmatch(r"sa-[0-9a-f]{8}", i) for i in ids)


def test_versions(spark):
    values = ["0.7.5", "0.7.10", "0.7.4", "1", "0.8-rc1", "x.y", "10.0.0.9", "0.10.3alpha"]
    assert apply(spark, values, versions.parse_version) == [
        [0, 7, 5], [0, 7, 10], [0, 7, 4], [1, 0, 0], [0, 8, 0], [0, 0, 0], [10, 0, 0], [0, 10, 3]
    ]
    assert apply(spark, values, lambda c: versions.version_at_least(c, (0, 7, 5))) == [
        True, True, False, True, True, False, True, True
    ]


def test_dates(spark):
    got = apply(spark, ["2014-02-05 14:02:00", "2024-03-03 00:09:59"],
                lambda c: dates.listing_time(c.cast("timestamp_ntz")))
    assert got == ["02/3/2014 (02:02 PM)", "03/0/2024 (12:09 AM)"]
    epoch = apply(spark, ["881250949", "x"],
                  lambda c: F.date_format(dates.epoch_timestamp(c), "yyyy-MM-dd HH:mm:ss"))
    assert epoch == ["1997-12-04 15:55:49", None]


def test_numbers(spark):
    values = ["12", " 3 ", "x", "", None, "4.5", "-7", "+8", "2147483648", "9" * 30, "\t5\n"]
    assert apply(spark, values, maths.safe_int) == [12, 3, 0, 0, 0, 0, -7, 8, 0, 0, 5]
    sizes = apply(spark, ["24", "16", "8", "32"], lambda c: maths.block_size(c.cast("int")))
    assert sizes == [2**8, 2**16, 2**24, 1]


def test_patterns(spark):
    args = F.array(F.lit("-v"), F.lit("--mode=cloud-1"), F.lit("--mode=x"))
    row = spark.range(1).select(
        patterns.deploy_arg(args, "mode", "local").alias("a"),
        patterns.deploy_arg(args, "conf", "local").alias("b"),
        patterns.strip_ansi(F.lit("\x1b[1;31mred\x1b[0m")).alias("c"),
        patterns.matches_dotall(F.lit("a\nb"), "a.b").alias("d"),
    ).first()
    assert tuple(row) == ("cloud", "local", "red", True)


def test_arrays_and_maps(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    left = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2))
    right = F.create_map(F.lit("y"), F.lit(9), F.lit("z"), F.lit(3))
    row = spark.range(1).select(
        arrays.distance(a, b).alias("d"),
        arrays.first_joined(F.array(*[F.lit(str(i)) for i in range(8)])).alias("j"),
        maps.merge_last_wins(left, right).alias("m"),
        maps.reverse_lookup(left, F.lit(2)).alias("r"),
        maps.reverse_lookup(left, F.lit(7)).alias("n"),
        maps.sorted_json(F.lit('{"b": 1, "a": {"d": [2, 1], "c": null}}')).alias("s"),
        maps.json_value(F.lit('[{"Config": {"Cmd": "run"}}]'), "$[0].Config.Cmd").alias("v"),
    ).first()
    assert row.asDict() == {
        "d": 5.0, "j": "0,1,2,3,4,5", "m": {"x": 1, "y": 9, "z": 3}, "r": "y", "n": None,
        "s": '{"a":{"c":null,"d":[2,1]},"b":1}', "v": "run",
    }


def test_registered_functions(spark):
    registry.register_sql_function(spark, "test_double", "x INT", "x * 2")
    registry.register_function(spark, "test_upper", _upper())
    row = spark.sql("SELECT test_double(4) AS d, test_upper('a') AS u").first()
    assert tuple(row) == (8, "A")
    listed = {r.name: r for r in registry.list_functions(spark, "test_*").collect()}
    assert listed["test_double"].is_temporary and listed["test_upper"].is_temporary


def _upper():
    def upper(s: pd.Series) -> pd.Series:
        return s.str.upper()

    return F.pandas_udf(upper, "string")


def test_templates(spark):
    df = spark.createDataFrame([(1, "a $X ${Y}b $$1 {p} {q} }"), (2, "none")], "i int, t string")
    out = projections.substitute_template(df, "t", {"X": "1", "Y": "$X", "p": "{q}"}, "o")
    assert [r.o for r in out.orderBy("i").collect()] == ["a 1 $Xb $1 {q} {q} }", "none"]
    for bad in ("$NOPE", "${NOPE}", "cost $ 5"):
        broken = spark.createDataFrame([(bad,)], "t string")
        with pytest.raises(Exception, match="unknown placeholder"):
            projections.substitute_template(broken, "t", {"X": "1"}, "o").collect()


def test_wide_and_tall_report(spark, rows):
    df = spark.createDataFrame([("one two three", 1), ("x", 22)], "name string, n int")
    out = report.format_report_columns(
        df, {"name": "l", "n": "r"}, {"n": "b"}, max_width={"name": 8}
    )
    got = rows(out, "line", "name", "n")
    assert got == sorted(
        [(0, "one two ", "  "), (1, "three   ", " 1"), (0, "x       ", "22")], key=repr
    )
    middle = report.format_report_columns(
        spark.createDataFrame([("a\nb\nc", "z")], "t string, u string"), valign={"u": "m"}
    )
    assert [r.u for r in middle.orderBy("line").collect()] == [" ", "z", " "]


def test_widths(spark):
    df = spark.createDataFrame([("漢字", None), ("a", "bb")], "t string, long_name string")
    assert tuple(column_widths(df).first()) == (4, 9)
    assert tuple(column_widths(df, header=False).first()) == (4, 4)
    assert tuple(column_widths(df, min_width={"t": 6}, max_width={"t": 3}).first()) == (6, 9)
    # 13 cells, 4 of padding and 2 frame marks make 19.
    assert tuple(column_widths(df, max_table_width=10).first()) == (2, 4)
    assert tuple(column_widths(df, min_table_width=38).first()) == (8, 18)
    empty = column_widths(df.filter("false"), min_width={"t": 6})
    assert tuple(empty.first()) == (1, 9)


def test_number_formats(spark):
    df = spark.createDataFrame([(7, 2.5, "x"), (None, None, None)], "i int, d double, s string")
    out = report.format_numbers(df, {"i": "4"}, {"d": "8.3"}).collect()
    assert [tuple(r) for r in out] == [("   7", "   2.500", "x"), ("None", "None", "None")]
    assert report.format_numbers(df, {"i": ""}, {"d": ""}).first().d == "2.500000"
    for ints, floats in (({"i": "x"}, {}), ({}, {"d": "8"}), ({}, {"d": "a.b"})):
        with pytest.raises(ValueError):
            report.format_numbers(df, ints, floats)


def test_selection_and_arity_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert projections.select_fields(df, ["b", "a"]).columns == ["a", "b"]
    assert projections.select_fields(df, None).columns == ["a", "b"]
    with pytest.raises(ValueError):
        projections.select_fields(df, ["c"])
    with pytest.raises(ValueError):
        sets.append_rows_checked(df, df.select("a"))
    assert sets.auto_field_names(df).columns == ["Field 1", "Field 2"]


def test_constraints(spark, rows):
    df = spark.createDataFrame([(1, None, ("x",)), (2, "a", ("y",))], "k int, s string, n struct<v:string>")
    assert rows(filters.filter_by_constraints(df, {}), "k") == [(1,), (2,)]
    assert rows(filters.filter_by_constraints(df, {"s": None}), "k") == [(1,)]
    assert rows(filters.filter_by_constraints(df, {"n.v": "y", "s": "a"}), "k") == [(2,)]
    assert filters.exists_where(df, {"k": 2}, {"s": "a"}).first().found is True
    assert filters.exists_where(df, {"k": 2}, {"s": "b"}).first().found is False


def test_defaults_and_instances(spark, rows):
    df = spark.createDataFrame([("a", None, None), ("b", 3, ["t"]), ("c", 1, []), ("d", 0, [])],
                               "name string, n int, tags array<string>")
    filled = projections.fill_defaults(df, {"tags": [], "n": 9})
    assert rows(filled.filter("name = 'a'")) == [("a", 9, [])]
    expanded = projections.expand_instances(df, "n", "name")
    assert rows(expanded, "name", "instance") == sorted(
        [("a", 0), ("b-0", 0), ("b-1", 1), ("b-2", 2), ("c", 0)], key=repr
    )
    total = df.select(projections.cluster_instances(F.lit(4), F.col("tags")).alias("t"), "name")
    assert {r.name: r.t for r in total.collect()} == {"a": 6, "b": 7, "c": 6, "d": 6}


def test_sentinels_hosts_and_shape(spark, rows):
    df = spark.createDataFrame([(" REPOSITORY",), ("<none>",), (" img ",), ("app/x",), ("",)], "i string")
    assert rows(filters.exclude_sentinels(df, "i")) == [("app/x",), ("img",)]
    assert rows(filters.exclude_sentinels(df, "i", name_pattern="^app/")) == [("app/x",)]
    said = spark.createDataFrame(
        [("h", " one ", 1), ("h", "two", 2), ("h", "  ", 3), ("g", "\n", 1)], "h string, o string, s int"
    )
    assert rows(outputs_by_host(said, "h", "o", "s")) == [("h", "two")]
    assert tuple(shape(df).first()) == (5, 1)
    assert [r.i for r in distinct_values(df.union(df), "i").collect()][0] == ""


def test_incomplete_credentials(spark, rows):
    df = spark.createDataFrame([(1, "u", "k"), (2, "u", None)], "i int, u string, k string")
    assert rows(projections.require_all_keys(df, ["u", "k"])) == [(1, "u", "k"), (2, None, None)]
