"""Column functions and report output on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import (
    arrays,
    dates,
    display,
    maps,
    maths,
    patterns,
    registry,
    strings,
    versions,
)
from millrace.operators import report
from millrace.operators.aggregates import column_widths
from millrace.operators.numbering import number_rows
from millrace.plans.registry import plan
from millrace.scratch import persist_table, scratch_path
from millrace.sources import trees
from millrace.sources.manifests import parse_manifests, scan_manifests

_VERSION = """
    CASE WHEN p_size < 5 THEN p_brand ELSE concat_ws('.', p_size // 10, p_size, p_partkey || 'rc1', 'x') END
"""


@plan(
    "version_compare",
    f"""
    WITH v AS (SELECT p_partkey, {_VERSION} AS version FROM part),
    n AS (SELECT p_partkey, version, list_transform(
        list_concat(string_split(version, '.')[1:3], ['0', '0', '0'])[1:3],
        lambda x: coalesce(try_cast(regexp_extract(x, '^[0-9]+') AS INTEGER), 0)) AS parts FROM v)
    SELECT p_partkey, version, array_to_string(parts, '.') AS parsed, parts >= [2, 10, 5] AS supported
    FROM n
    """,
)
def _(t):
    rows = t.part.select("p_partkey", F.expr(_VERSION.replace("//", "div")).alias("version"))
    parsed = versions.parse_version(F.col("version"))
    return rows.select(
        "p_partkey",
        "version",
        F.array_join(parsed.cast("array<string>"), ".").alias("parsed"),
        versions.version_at_least(F.col("version"), (2, 10, 5)).alias("supported"),
    )


@plan(
    "fn_string",
    r"""
    WITH d AS (SELECT doc_id, text, lang, source, n_chars, lang || doc_id AS tag,
                 source || '-of ' || upper(lang) || doc_id || 'th_text' AS label,
                 regexp_replace(text, '[^\x20-\x7e\n]', '?', 'g') AS ascii FROM documents),
    s AS (SELECT *, greatest(11 - length(tag), 0) AS spare,
            CASE WHEN length(tag) % 2 = 0 THEN 1 ELSE 0 END AS extra FROM d)
    SELECT doc_id,
      replace(ascii, ',', ' ') AS replaced,
      contains(text, 'the') AS has_the,
      regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS stripped,
      left(text, 21) AS prefix,
      upper(left(label, 1)) || lower(substr(label, 2)) AS capped,
      list_aggregate(list_transform(regexp_extract_all(label, '[A-Za-z]+|[^A-Za-z]+'),
        lambda r: upper(left(r, 1)) || lower(substr(r, 2))), 'string_agg', '') AS titled,
      length(ascii) AS width,
      (SELECT max(length(x)) FROM (SELECT unnest(string_split(ascii, chr(10))) AS x)) AS text_width,
      repeat(' ', spare::BIGINT) || tag AS right_justified,
      tag || repeat(' ', spare::BIGINT) AS left_justified,
      repeat(' ', (spare + extra) // 2) || tag || repeat(' ', spare - (spare + extra) // 2) AS centred,
      'se-' || left(sha256(doc_id::VARCHAR), 8) AS short_id,
      source || '-' || doc_id || '-' || lang || ':SNAPSHOT-' || n_chars AS snapshot
    FROM s
    """,
)
def _(t):
    docs = t.documents.withColumns(
        {
            "ascii": F.regexp_replace("text", r"[^\x20-\x7e\n]", "?"),
            "tag": F.concat("lang", "doc_id"),
            "label": F.concat("source", F.lit("-of "), F.upper("lang"), "doc_id", F.lit("th_text")),
        }
    )
    text, tag, number = F.col("ascii"), F.col("tag"), F.col("doc_id")
    return docs.select(
        "doc_id",
        F.replace(text, F.lit(","), F.lit(" ")).alias("replaced"),
        F.contains("text", F.lit("the")).alias("has_the"),
        strings.strip(F.col("text")).alias("stripped"),
        F.substring("text", 1, 21).alias("prefix"),
        strings.capitalize(F.col("label")).alias("capped"),
        strings.title(F.col("label")).alias("titled"),
        display.line_width(text).cast("bigint").alias("width"),
        display.display_width(text).cast("bigint").alias("text_width"),
        display.justify(tag, F.lit(11), "r").alias("right_justified"),
        display.justify(tag, F.lit(11), "l").alias("left_justified"),
        display.justify(tag, F.lit(11), "c").alias("centred"),
        strings.short_id(strings.ID_PREFIXES["service"], number).alias("short_id"),
        strings.snapshot_name(F.col("source"), number, F.col("lang"), F.col("n_chars")).alias("snapshot"),
    )


@plan(
    "fn_wrap",
    r"""
    WITH d AS (SELECT doc_id, regexp_replace(text, '[^a-zA-Z ]+', ' ', 'g') AS line FROM documents),
    w AS (SELECT doc_id, list_filter(string_split(line, ' '), lambda x: x <> '') AS words FROM d),
    m AS (SELECT doc_id, words, greatest(list_max(list_transform(words, lambda x: length(x))), 30) AS width
          FROM w),
    r AS (SELECT doc_id, list_reduce(words, lambda acc, x:
            CASE WHEN length(string_split(acc, chr(10))[-1]) + 1 + length(x) <= width
                 THEN acc || ' ' || x ELSE acc || chr(10) || x END) AS text FROM m)
    SELECT doc_id, text, len(string_split(text, chr(10))) AS lines FROM r
    """,
)
def _(t):
    letters = F.regexp_replace("text", "[^a-zA-Z ]+", " ")
    rows = t.documents.select("doc_id", strings.words(letters).alias("words"))
    longest = F.array_max(F.transform("words", F.char_length))
    rows = rows.withColumn("width", F.greatest(longest, F.lit(30)))
    lines = display.wrap(F.array_join("words", " "), F.col("width"))
    wrapped = rows.select("doc_id", lines.alias("lines"))
    return wrapped.select(
        "doc_id", F.array_join("lines", "\n").alias("text"), F.size("lines").cast("bigint").alias("lines")
    )


@plan(
    "fn_file_names",
    r"""
    WITH u AS (SELECT page_id, regexp_replace(url, '[?].*$', '') || '.tar.' || lang AS url FROM
      (SELECT page_id, url, CASE WHEN contains(url, 'fr') THEN 'gz' ELSE 'yaml' END AS lang FROM pages))
    SELECT page_id, string_split(url, '://')[1] AS scheme, string_split(url, '://')[2] AS rest,
      string_split(url, '/')[-1] AS name,
      regexp_replace(string_split(url, '/')[-1], '[.][^.]*$', '') AS stem,
      string_split(url, '.')[-1] AS extension
    FROM u
    """,
)
def _(t):
    url = F.concat(
        F.regexp_replace("url", "[?].*$", ""),
        F.lit(".tar."),
        F.when(F.contains("url", F.lit("fr")), "gz").otherwise("yaml"),
    )
    scheme, rest = strings.split_scheme(url)
    return t.pages.select(
        "page_id",
        scheme.alias("scheme"),
        rest.alias("rest"),
        strings.file_name(url).alias("name"),
        strings.file_stem(url).alias("stem"),
        strings.file_extension(url).alias("extension"),
    )


@plan(
    "fn_regex",
    r"""
    WITH e AS (SELECT event_id, event_type, user_id,
        chr(27) || '[1;31m' || event_type || chr(27) || '[0m' AS coloured,
        CASE event_type WHEN 'error' THEN ['--mode=local' || user_id, '--mode=x']
          WHEN 'click' THEN ['-v', '--mode=cloud-' || user_id] WHEN 'view' THEN ['--mode=', '--mode=z']
          ELSE ['--other=1'] END AS args FROM events)
    SELECT event_id, regexp_matches('a' || chr(10) || event_type, '(?s)a.e') AS dotall,
      regexp_replace(coloured, '\x1b\[[0-9;]*m', '', 'g') AS plain,
      CASE event_type WHEN 'error' THEN 'local' || user_id WHEN 'click' THEN 'cloud' WHEN 'view' THEN 'z'
        ELSE 'default' END AS mode
    FROM e
    """,
)
def _(t):
    user = F.col("user_id").cast("string")
    args = (
        F.when(F.col("event_type") == "error", F.array(F.concat(F.lit("--mode=local"), user), F.lit("--mode=x")))
        .when(F.col("event_type") == "click", F.array(F.lit("-v"), F.concat(F.lit("--mode=cloud-"), user)))
        .when(F.col("event_type") == "view", F.array(F.lit("--mode="), F.lit("--mode=z")))
        .otherwise(F.array(F.lit("--other=1")))
    )
    coloured = F.concat(F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m"))
    return t.events.select(
        "event_id",
        patterns.matches_dotall(F.concat(F.lit("a\n"), "event_type"), "a.e").alias("dotall"),
        patterns.strip_ansi(coloured).alias("plain"),
        patterns.deploy_arg(args, "mode", "default").alias("mode"),
    )


@plan(
    "fn_date",
    """
    SELECT event_id, strftime(ts, '%m/%w/%Y (%I:%M %p)') AS listed,
      floor(epoch(ts))::BIGINT AS from_epoch
    FROM events
    """,
)
def _(t):
    seconds = dates.epoch_seconds(F.col("ts")).cast("string")
    return t.events.select(
        "event_id",
        dates.listing_time(F.col("ts")).alias("listed"),
        F.unix_seconds(dates.epoch_timestamp(seconds)).alias("from_epoch"),
    )


@plan(
    "fn_math",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
      round(sqrt(l_extendedprice), 4) AS root, round(l_discount * l_discount, 6) AS square,
      greatest(l_quantity, 10.0::DOUBLE) AS at_least, least(l_quantity, 40.0::DOUBLE) AS at_most,
      l_partkey // 7 AS whole, ceil(l_extendedprice / 100)::BIGINT AS up,
      floor(l_extendedprice / 100)::BIGINT AS down,
      CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS parsed,
      (1::BIGINT << (32 - (l_linenumber + 16))) AS block
    FROM lineitem
    """,
)
def _(t):
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" "), "l_linenumber")).otherwise(
        F.concat("l_returnflag", "l_linenumber")
    )
    price = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(F.sqrt(price), 4).alias("root"),
        F.round(maths.squared(F.col("l_discount")), 6).alias("square"),
        F.greatest("l_quantity", F.lit(10.0)).alias("at_least"),
        F.least("l_quantity", F.lit(40.0)).alias("at_most"),
        F.expr("l_partkey div 7").alias("whole"),
        F.ceil(price / 100).alias("up"),
        F.floor(price / 100).alias("down"),
        maths.safe_int(text).alias("parsed"),
        maths.block_size(F.col("l_linenumber") + 16).alias("block"),
    )


@plan(
    "fn_array",
    """
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id,
      round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS length,
      round(list_sum(list_transform(v, lambda x: (x - v[1]) * (x - v[1]))), 5) AS spread,
      v[1] AS first, len(v[2:]) AS rest,
      array_to_string(list_transform(range(label, label + 9), lambda i: i::VARCHAR)[1:6], ',') AS joined,
      len(flatten([range(label), range(3)])) AS flat,
      list_contains(range(label), 4) AS has_four
    FROM e
    """,
)
def _(t):
    v, label = F.col("embedding").cast("array<double>"), F.col("label")
    shifted = arrays.subtract(v, F.array_repeat(v[0], F.size(v)))
    upto = F.filter(F.sequence(F.lit(0), label), lambda i: i < label)
    return t.embeddings.select(
        "vec_id",
        F.round(arrays.norm(v), 5).alias("length"),
        F.round(arrays.sum_of_squares(shifted), 5).alias("spread"),
        F.element_at(v, 1).alias("first"),
        F.size(F.slice(v, F.lit(2), F.size(v) - 1)).cast("bigint").alias("rest"),
        arrays.first_joined(F.sequence(label, label + 8).cast("array<string>")).alias("joined"),
        F.size(F.flatten(F.array(upto, F.sequence(F.lit(0), F.lit(2))))).cast("bigint").alias("flat"),
        F.array_contains(upto, 4).alias("has_four"),
    )


@plan(
    "fn_map_json",
    """
    SELECT event_id, 'k' AS keys, json_extract(props, '$.k')::BIGINT AS k,
      CASE WHEN json_extract(props, '$.k')::BIGINT = 4 THEN 'k' WHEN user_id = 4 THEN 'user' END AS found,
      CASE WHEN event_type = 'view' THEN event_type ELSE json_extract(props, '$.k')::VARCHAR END AS merged,
      '{"a":[1,2],"k":' || json_extract(props, '$.k')::VARCHAR || ',"z":"' || event_type || '"}' AS sorted,
      event_type AS command
    FROM events
    """,
)
def _(t):
    props = F.from_json("props", "map<string,string>")
    more = F.map_from_arrays(
        F.array(F.lit("k"), F.lit("user")),
        F.array(F.col("event_type"), F.col("user_id").cast("string")),
    )
    only_user = F.map_filter(more, lambda k, _v: k == "user")
    both = maps.merge_last_wins(
        props, F.when(F.col("event_type") == "view", more).otherwise(only_user)
    )
    doc = F.concat(
        F.lit('{"z": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"),
        F.lit(', "a": [1, 2]}'),
    )
    inspected = F.concat(F.lit('[{"Config": {"Cmd": "'), "event_type", F.lit('"}}]'))
    return t.events.select(
        "event_id",
        F.array_join(F.map_keys(props), ",").alias("keys"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        maps.reverse_lookup(maps.merge_last_wins(props, only_user), F.lit("4")).alias("found"),
        both["k"].alias("merged"),
        maps.sorted_json(doc).alias("sorted"),
        maps.json_value(inspected, "$[0].Config.Cmd").alias("command"),
    )


@plan(
    "indented_json",
    """
    SELECT o_orderkey, '{' || chr(10) || '  "compute":[' || chr(10) || '    "a]{",' || chr(10) || '    {}' || chr(10) || '  ],' || chr(10)
      || '  "status":"' || o_orderstatus || '",' || chr(10) || '  "storage":{' || chr(10)
      || '    "class":"' || o_orderpriority || '",' || chr(10) || '    "custkey":' || o_custkey || chr(10) || '  }' || chr(10) || '}' AS text
    FROM orders
    """,
)
def _(t):
    doc = F.concat(
        F.lit('{"status": "'), "o_orderstatus", F.lit('", "storage": {"custkey":'), F.col("o_custkey").cast("string"),
        F.lit(', "class" : "'), "o_orderpriority", F.lit('"}, "compute": ["a]{", {}]}'),
    )
    return t.orders.select("o_orderkey", maps.indented_json(doc).alias("text"))


@plan(
    "register_function",
    "SELECT p_partkey, p_retailprice * 2 + p_size AS score FROM part",
)
def _(t):
    registry.register_sql_function(
        t.spark, "millrace_score", "price DOUBLE, size INT", "price * 2 + size"
    )
    return t.part.selectExpr("p_partkey", "millrace_score(p_retailprice, p_size) AS score")


# -- report output ----------------------------------------------------------------------


@plan(
    "format_numbers",
    """
    SELECT printf('%8d', o_orderkey) AS o_orderkey, printf('%12.2f', o_totalprice) AS o_totalprice,
           o_orderstatus
    FROM orders
    """,
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return report.format_numbers(rows, {"o_orderkey": "8"}, {"o_totalprice": "12.2"})


@plan(
    "format_report_columns",
    """
    WITH w AS (SELECT greatest(max(length(p_partkey::VARCHAR)), 9) AS k,
        greatest(max(length(p_name)), 6) AS n, greatest(max(length(p_brand)), 7, 14) AS b FROM part)
    SELECT 0 AS line, lpad(p_partkey::VARCHAR, k::INTEGER, ' ') AS p_partkey, rpad(p_name, n::INTEGER, ' ') AS p_name,
      repeat(' ', (b - length(p_brand) + CASE WHEN length(p_brand) % 2 = 0 THEN 1 ELSE 0 END) // 2) || p_brand
      || repeat(' ', b - length(p_brand)
                - (b - length(p_brand) + CASE WHEN length(p_brand) % 2 = 0 THEN 1 ELSE 0 END) // 2) AS p_brand
    FROM part, w
    """,
)
def _(t):
    rows = t.part.select("p_partkey", "p_name", "p_brand")
    return report.format_report_columns(
        rows, {"p_partkey": "r", "p_name": "l", "p_brand": "c"}, min_width={"p_brand": 14}
    )


@plan(
    "report_header",
    """
    WITH w AS (SELECT greatest(max(length(p_name)), 6) AS n FROM part)
    SELECT 0 AS line, rpad('P_NAME', n::INTEGER, ' ') AS p_name FROM w
    UNION ALL SELECT 1, rpad('------', n::INTEGER, ' ') FROM w
    """,
)
def _(t):
    names = t.part.select("p_name")
    return report.report_header(names, column_widths(names), {"p_name": "l"}, "upper")


_STACK_LISTING = """
    SELECT 'sa-' || o_orderkey AS "UUID",
      CASE WHEN o_orderstatus = 'F' THEN ' ' ELSE 'se-' || o_custkey END AS "Storage",
      CASE WHEN o_orderstatus = 'O' THEN ' ' ELSE '[se-' || o_custkey || ', se-x]' END AS "Compute",
      'sc-' || o_custkey AS "Connectors",
      o_orderstatus AS "Status", o_orderpriority AS "Base",
      CASE WHEN c_custkey IS NULL THEN '' ELSE strftime(o_orderdate, '%m/%w/%Y (%I:%M %p)') END AS "Time"
    FROM orders LEFT JOIN customer ON c_custkey + 10 = o_custkey
"""


@plan("stack_listing", f'SELECT *, row_number() OVER (ORDER BY "UUID") AS rn FROM ({_STACK_LISTING})')
def _(t):
    service = F.concat(F.lit("se-"), "o_custkey")
    backend = F.struct(
        F.when(F.col("o_orderstatus") != "F", service).alias("storage"),
        F.when(F.col("o_orderstatus") != "O", F.array(service, F.lit("se-x"))).alias("compute"),
    )
    stacks = t.orders.select(
        F.concat(F.lit("sa-"), "o_orderkey").alias("uuid"),
        F.col("o_custkey").alias("snapshot_uuid"),
        F.array(F.concat(F.lit("sc-"), "o_custkey")).alias("connectors"),
        F.struct(F.array(backend).alias("uuids")).alias("backends"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("base"),
        F.col("o_orderdate").alias("ts"),
    )
    taken = t.customer.select((F.col("c_custkey") + 10).alias("snapshot_uuid"))
    return number_rows(report.stack_listing(stacks, taken), ["UUID"], "rn", unique=True)


@plan(
    "snapshot_listing",
    """
    SELECT *, row_number() OVER (ORDER BY "Date", "UUID") AS rn FROM (
      SELECT 'sn-' || o_orderkey AS "UUID", c_mktsegment AS "Base",
        CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE strftime(o_orderdate, '%m/%w/%Y (%I:%M %p)') END AS "Date"
      FROM orders JOIN customer ON o_custkey = c_custkey + 10)
    """,
)
def _(t):
    taken = t.orders.select(
        F.concat(F.lit("sn-"), "o_orderkey").alias("snapshot_uuid"),
        F.col("o_custkey").alias("cluster_uuid"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("snapshot_ts"),
    )
    known = t.customer.select(
        (F.col("c_custkey") + 10).alias("uuid"), F.col("c_mktsegment").alias("base")
    )
    return number_rows(report.snapshot_listing(taken, known), ["Date", "UUID"], "rn", unique=True)


def manifest_files(t):
    """Each part as a manifest text: JSON, YAML, or a file without metadata."""
    text = F.concat(F.col("p_type"), F.lit(" part called "), F.col("p_name"))
    storage = F.struct(F.lit("hadoop").alias("personality"), F.col("p_size").alias("instances"))
    as_json = F.to_json(
        F.struct(
            F.struct(
                F.col("p_brand").alias("author"),
                F.concat(F.lit("0."), "p_size").alias("version"),
                text.alias("description"),
                F.lit("http://example.com/").alias("url"),
                F.array("p_type", F.lit("part")).alias("tags"),
            ).alias("metadata"),
            F.struct(F.lit("default").alias("resolver")).alias("params"),
            F.array(F.struct(storage.alias("storage"))).alias("backend"),
            F.array(F.struct(F.lit("client").alias("personality"))).alias("connectors"),
        )
    )
    as_yaml = F.concat(
        F.lit("metadata:\n  author: "), "p_brand", F.lit("\n  version: '0."), "p_size",
        F.lit("'\n  description: "), text, F.lit("\n  icon: part.png\n  tags: ["), "p_type",
        F.lit(", part]\n  url: http://example.com/\nparams:\n  resolver: default\n"),
        F.lit("questions:\n  - question: Number of instances\n    param: \"{instances}\"\n"),
        F.lit("backend:\n  - storage:\n      personality: hadoop\n      instances: "), "p_size",
        F.lit("\nconnectors:\n  - personality: client\n    ports: ['80:80']\n"),
    )
    shape = F.expr("CASE WHEN p_size < 10 THEN 'none' WHEN p_size < 30 THEN 'json' ELSE 'yaml' END")
    return t.part.select(
        F.concat(
            F.lit("file:/apps/"), "p_brand", F.lit("/app"), "p_partkey",
            F.when(shape == "yaml", F.when(F.col("p_size") < 40, ".yaml").otherwise(".yml")).otherwise(".json"),
        ).alias("path"),
        F.when(shape == "none", F.lit('{"params": {}}'))
        .when(shape == "json", as_json)
        .otherwise(as_yaml)
        .alias("content"),
    )


@plan(
    "scan_manifests",
    """
    SELECT 'app' || p_partkey AS name,
      CASE WHEN p_size < 10 THEN 'Unknown' ELSE p_brand END AS author,
      CASE WHEN p_size < 10 THEN 'Unknown' ELSE '0.' || p_size END AS version,
      CASE WHEN p_size < 10 THEN '' ELSE left(p_type || ' part called ' || p_name, 21) || '...' END AS short,
      CASE WHEN p_size < 30 THEN '' ELSE 'part.png' END AS icon,
      CASE WHEN p_size < 10 THEN '' ELSE p_type || ',part' END AS tags,
      CASE WHEN p_size < 30 THEN 0 ELSE 1 END AS questions,
      CASE WHEN p_size < 10 THEN '' ELSE p_size::VARCHAR END AS instances
    FROM part
    """,
)
def _(t):
    root = scratch_path(t.spark, "plans")
    made = manifest_files(t)
    trees.write_files(made, root, F.replace("path", F.lit("file:/apps/"), F.lit("")), F.col("content"))
    return scan_manifests(t.spark, root).select(
        "name", "author", "version", "short", "icon",
        F.array_join("tags", ",").alias("tags"),
        F.size("questions").alias("questions"),
        F.coalesce(F.get("plan.backend", F.lit(0))["storage"]["instances"], F.lit("")).alias("instances"),
    )


@plan(
    "app_listing",
    """
    SELECT 'app' || p_partkey AS "App", CASE WHEN p_size < 10 THEN 'Unknown' ELSE p_brand END AS "Author",
      CASE WHEN p_size < 10 THEN 'Unknown' ELSE '0.' || p_size END AS "Version",
      CASE WHEN p_size < 10 THEN '' ELSE left(p_type || ' part called ' || p_name, 21) || '...' END AS "Description",
      row_number() OVER (ORDER BY 'app' || p_partkey) AS rn
    FROM part
    """,
)
def _(t):
    # A range sort reads its input twice (to sample it first), so the parsed texts are written once.
    apps = persist_table(report.app_listing(parse_manifests(manifest_files(t))), "apps")
    return number_rows(apps, ["App"], "rn", unique=True)


@plan(
    "image_listing",
    """
    SELECT "Image", row_number() OVER (ORDER BY "Image") AS rn FROM (SELECT DISTINCT p_name AS "Image" FROM part)
    """,
)
def _(t):
    return number_rows(report.image_listing(t.part, "p_name"), ["Image"], "rn", unique=True)
