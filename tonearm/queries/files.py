"""Metadata files and exports. The driver gives no such files, so their texts are made from its tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import layout as L
from ..operators import bulk as B
from ..sources import bulk as SB
from ..sources import messages as SX
from ..sources import metadata as SM
from ..sources import stores as K
from ..sources import uploads as SU
from . import tables as T

#: Rows of a made-up file: as uploads are small, a file is one value.
BLOCK = 100


def _texts(rows, k, line, header):
    """path and text of files of BLOCK rows by key; header is a column of the file's number f, null where a file has none."""
    g = rows.groupBy(F.floor(F.col(k) / BLOCK).alias("f")).agg(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), line.alias("line")))).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return g.select(F.concat(F.lit("file-"), F.col("f").cast("string")).alias("path"), F.concat_ws("\n", header, lines).alias("text"))


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def bulk_file_scan(spark, d):
    """Every second file has commas, every third a header, every fourth the old columns; some lines are blank or have no EAN."""
    p = T.load(spark, d, "part").withColumn("f", F.floor(F.col("p_partkey") / BLOCK))
    k, f = F.col("p_partkey"), F.col("f")
    text = k.cast("string")
    artist = F.when(f % 2 == 1, F.concat(F.lit('"'), "p_brand", F.lit(", "), text, F.lit('"'))).otherwise(F.col("p_brand"))
    head = [F.when(k % 10 == 8, "").otherwise(F.lpad(text, 13, "0")), artist, F.concat(F.lit(" "), "p_name"), F.lpad((k * 31 % 1000000).cast("string"), 6, "0"), F.when(k % 4 == 0, "Imp").otherwise(""), F.when(k % 6 > 0, "Lab").otherwise(""), F.lit("00")]
    old = [F.lpad(text, 16, "0"), F.concat(F.lit("T"), F.lpad(text, 10, "0"))]
    new = [F.lit("AB"), F.lit("US"), F.when(k % 3 == 0, old[0]).otherwise(""), F.when(k % 5 == 0, old[1]).otherwise("")]
    joined = lambda sep: F.when(f % 4 == 3, F.concat_ws(sep, *head, *old)).otherwise(F.concat_ws(sep, *head, *new))
    line = F.when(k % 10 == 9, "").when(f % 2 == 1, joined(",")).otherwise(joined("|"))
    header = F.when((f % 3 == 0) & (f % 2 == 1), "EAN,Artist,Title").when(f % 3 == 0, "EAN|Artist|Title")
    return SB.parse_releases(_texts(p, "p_partkey", line, header)).withColumn("release_date", _day("release_date"))


def _isrc_files(spark, d):
    """4 to 7 columns."""
    c = T.load(spark, d, "customer")
    k = F.col("c_custkey")
    text = F.lpad(k.cast("string"), 5, "0")
    cells = [
        F.when(k % 5 == 0, "BAD").when(k % 5 < 3, F.concat(F.lit("us-pr1-26-"), text)).otherwise(F.concat(F.lit("USPR126"), text)), F.when(k % 7 > 0, F.col("c_name")).otherwise(""), F.when(k % 11 > 0, F.col("c_mktsegment")).otherwise(" "),
        F.when(k % 6 == 0, "13").otherwise(F.lpad((k * 31 % 1000000).cast("string"), 6, "0")), F.when(k % 3 == 0, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").otherwise("AB"), F.lit("Lab"), F.when(k % 3 == 0, "us").when(k % 3 == 1, "ZZ").otherwise(""),
    ]
    line = F.array_join(F.slice(F.array(*cells), F.lit(1), (k % 4).cast("int") + 4), "|")
    return SB.parse_isrcs(_texts(c, "c_custkey", line, F.when(F.col("f") % 2 == 0, "ISRC|Artist|Title|Date")))


def isrc_file_scan(spark, d):
    return _isrc_files(spark, d).withColumn("release_date", _day("release_date"))


def isrc_file_checks(spark, d):
    return B.check_isrcs(_isrc_files(spark, d), ["GB", "US"], ["path", "row_number"]).select("path", "row_number", "rule_id", "severity")


#: Files by number, in every query over written CSV uploads.
_EMPTY, _LATIN, _SHORT = "f % 11 = 3", "f % 11 = 5", "f % 7 = 2"


def _csv_cells(k):
    """Cells of a metadata CSV: an order is a track, three are a release; UPCs come again in other files."""
    return {
        "upc": F.when(k % 30 < 27, F.lpad((F.floor(k / 3) % 5000).cast("string"), F.when(k % 5 == 4, 11).otherwise(12), "0")).otherwise(" "), "release_title": F.when(k % 4 > 0, F.concat(F.lit('R, "x" '), k.cast("string"))).otherwise(" "), "artist_name": F.lit("A"),
        "release_date": F.element_at(F.array(F.lit("1/2/98"), F.lit("2020-13-45"), F.lit("2020"), F.lit("2020-1"), F.lit(""), _day("o_orderdate")), (k % 6).cast("int") + 1), "label_name": F.col("o_orderpriority"),
        "isrc": F.element_at(F.array(F.lit(""), F.lit("bad"), F.lit("us-pr1-26-00001"), F.lit("US-PR126-00001"), F.lit("USPR12600001")), (k % 5).cast("int") + 1),
        "track_title": F.concat(F.lit("T"), k.cast("string")), "track_number": F.element_at(F.array(F.lit("x"), F.lit("+3"), F.lit("1.5"), F.lit(""), F.lit("1_0"), F.lit("7")), (F.floor(k / 2) % 6).cast("int") + 1),
        "duration": F.when(k % 6 == 0, "4m").when(k % 6 == 1, "1:2:3").when(k % 7 == 2, "").otherwise(F.concat((k % 10).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))),
        "explicit": F.element_at(F.array(F.lit("TRUE"), F.lit("no"), F.lit("1"), F.lit("")), (k % 4).cast("int") + 1),
    }


def _csv_uploads(spark, d):
    """Writes the cells as files of BLOCK rows and reads them back: other headers and orders of columns, quotes, blank lines; some empty, not UTF-8, or short of a column."""
    o = T.load(spark, d, "orders").withColumn("f", F.floor(F.col("o_orderkey") / BLOCK))
    cells = _csv_cells(F.col("o_orderkey"))
    quoted = lambda c: F.when(c.rlike('[",]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda names: F.array_join(F.array(*[quoted(F.coalesce(cells[n], F.lit(""))) for n in names]), ",")
    names = list(cells)
    short, turned = [n for n in names if n not in ("isrc", "label_name")], names[::-1]
    header = F.when(F.expr(_SHORT), ",".join(short)).when(F.expr("f % 3 = 1"), "\ufeff" + ",".join(f" {n.upper()} " for n in turned)).otherwise(",".join(names))
    text = F.when(F.expr(_SHORT), line(short)).when(F.expr("f % 3 = 1"), line(turned)).otherwise(line(names))
    text = F.concat(text, F.when(F.col("o_orderkey") % 9 == 0, "\r\n").otherwise(""))  # a blank line after it
    files = o.groupBy("f", header.alias("header")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("line")))).alias("rows"))
    body = F.when(F.expr(_EMPTY), F.unhex(F.lit(""))).otherwise(F.concat(F.concat_ws("\r\n", "header", F.array_join(F.transform("rows", lambda r: r["line"]), "\r\n")).cast("binary"), F.when(F.expr(_LATIN), F.unhex(F.lit("E9FF"))).otherwise(F.unhex(F.lit("")))))
    folder = SU.shared_folder(spark, "csv-uploads")
    SU.write_files(files.select(F.concat(F.lit("file-"), F.col("f").cast("string"), F.lit(".csv")).alias("path"), body.alias("content")), folder)
    return SU.read_uploads(spark, folder, "csv", suffix=".csv")


def csv_releases(spark, d):
    """First row's fields of each UPC of a file, and its tracks in order, as text."""
    track = lambda t: F.concat_ws(":", t["line"].cast("string"), t["isrc"], F.coalesce(t["track_number"].cast("string"), F.lit("?")), F.coalesce(t["duration_ms"].cast("string"), F.lit("?")), F.when(t["explicit"], "E").otherwise("-"))
    return SM.releases_of_csv(_csv_uploads(spark, d)).select("path", "upc", "title", "artist", "label", "release_date", "release_type", F.array_join(F.transform("tracks", track), "|").alias("tracks"), F.array_join("isrc_list", "|").alias("isrcs"))


def csv_findings(spark, d):
    """All findings of the written files, those of whole files too."""
    return SM.csv_findings(_csv_uploads(spark, d)).select("path", "line", "rule_id", "severity", "actual")


def _json_texts(spark, d):
    """Releases as JSON with faults of every kind: broken texts, other structures, fields of other types, tracks that are none."""
    o = L.spread(T.load(spark, d, "orders").select("o_orderkey"), 20_000)  # a file of few bytes is one task, and taking texts apart is the work
    k = F.col("o_orderkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int") + 1)
    upc = F.when(k % 4 == 3, F.concat(F.lit('"'), F.lpad(k.cast("string"), 12, "0"), F.lit('"'))).otherwise(pick(k, '""', '"abc"', "123456789012"))
    track = F.concat(F.lit('{"isrc":'), pick(k, '"USPR12600001"', '"us-pr1-26-00001"', "null", '""', '"US-PR126-00001"'), F.lit(',"title":'), pick(F.floor(k / 3), '"T"', '" "', "0", "[]"), F.lit(',"track_number":'), pick(F.floor(k / 2), "3", '"4"', '"x"', "null", "2.5", "[1]", "true"), F.lit(',"duration_ms":'), pick(F.floor(k / 5), "1000", '"1m"', "{}"), F.lit("}"))
    tracks = F.when(k % 9 == 0, "[]").when(k % 9 == 1, '{"a":1}').when(k % 9 == 2, "null").when(k % 9 == 3, F.concat(F.lit('[7,'), track, F.lit(",null]"))).otherwise(F.concat(F.lit("["), track, F.lit(","), track, F.lit("]")))
    body = F.concat(
        F.lit('{"upc":'), upc, F.lit(',"title":"R \\"q\\" '), k.cast("string"), F.lit('","artist":'), pick(k, '"A"', '" "', "0", "false", '"B"'), F.lit(',"label":"L","release_date":'),
        pick(F.floor(k / 7), '"2020-13-45"', '"2020/01/01"', '""', '"2021-05-06"', "20200101"), F.lit(',"deals":'), pick(F.floor(k / 11), "[]", '[{"territory":"DE"},3]', '"x"', "null"), F.lit(',"tracks":'), tracks, F.lit("}"),
    )
    text = F.when(k % 20 == 0, "{").when(k % 20 == 1, F.concat(F.lit("\ufeff["), body, F.lit(",5,"), body, F.lit("]"))).when(k % 20 == 2, "3").otherwise(body)
    return o.select(k.cast("string").alias("path"), text.alias("text"))


def json_releases(spark, d):
    track = lambda t: F.concat_ws(":", F.coalesce(t["isrc"], F.lit("?")), F.coalesce(t["title"], F.lit("?")), F.coalesce(t["track_number"].cast("string"), F.lit("?")), F.coalesce(t["duration_ms"].cast("string"), F.lit("?")))
    r = SM.releases_of_json(_json_texts(spark, d)).where("release is not null")
    return r.select("path", "pos", "release.upc", "release.title", "release.artist", "release.release_date", F.coalesce(F.size("release.deals"), F.lit(-1)).alias("n_deals"), F.array_join(F.transform("tracks", track), "|").alias("tracks"))


def json_findings(spark, d):
    return SM.json_findings(_json_texts(spark, d)).select("path", "rule_id", "severity", "field")


def _message_texts(spark, d):
    """Release messages: some broken, without namespace, sections, headers or publishers, or with bad identifiers."""
    o = T.load(spark, d, "orders")
    k = F.col("o_orderkey")
    name = k.cast("string")
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    some = lambda condition, c: F.when(condition, c).otherwise("")
    recipient = some(k % 5 > 0, tag("MessageRecipient", F.lit("x")))
    header = tag("MessageHeader", F.concat(tag("MessageId", name), F.lit("<MessageSender>s</MessageSender>"), recipient, F.lit("<MessageCreatedDateTime>2024-01-01</MessageCreatedDateTime>")))
    isrc = F.when(k % 6 == 0, "BAD").otherwise(F.concat(F.lit("USPR126"), F.lpad(name, 5, "0")))
    recording = tag("SoundRecording", F.concat(tag("ISRC", isrc), tag("TitleText", F.concat(F.lit("S "), name)), some(k % 7 > 2, F.lit("<DisplayPublisher>P</DisplayPublisher>"))))
    release = F.concat(F.lit('<Release IsMainRelease="true">'), tag("UPC", F.when(k % 8 == 0, "bad").otherwise(F.lpad(name, 12, "0"))), tag("TitleText", F.concat(F.lit("R &amp; "), name)), tag("LabelName", F.col("o_orderpriority")), F.lit("</Release>"))
    deal = tag("ReleaseDeal", F.concat(F.lit("<DealReleaseReference>R0</DealReleaseReference>"), tag("Deal", tag("DealTerms", F.concat(F.lit("<UseType>Stream</UseType><TerritoryCode>DE</TerritoryCode>"), tag("ValidityPeriod", tag("StartDate", _day("o_orderdate"))))))))
    root = F.when(k % 3 > 0, F.lit("<NewReleaseMessage xmlns='http://x/xml/ern/41'>")).otherwise("<NewReleaseMessage>")
    whole = F.concat(root, header, tag("ResourceList", recording), tag("ReleaseList", release), some(k % 4 > 0, tag("DealList", deal)), F.lit("</NewReleaseMessage>"))
    return o.select(name.alias("path"), F.when(k % 10 == 0, "<broken").otherwise(whole).alias("text"))


def _messages(spark, d):
    return _message_texts(spark, d).select("path", SX.parse_xml(F.col("text")).alias("m"))


def message_tracks(spark, d):
    """A table function in SQL text, joined laterally: a row a track."""
    SX.register_table_functions(spark)
    _message_texts(spark, d).createOrReplaceTempView("message_files")
    return spark.sql("SELECT path, t.error IS NULL AS whole, t.message_id, t.upc, t.pos, t.isrc, t.title, t.publisher FROM message_files, LATERAL parse_message(text) AS t")


def csv_lateral(spark, d):
    """Another, whose columns are its arguments."""
    SX.register_table_functions(spark)
    o = T.load(spark, d, "orders")
    k = F.col("o_orderkey")
    _texts(o, "o_orderkey", F.concat_ws(",", k.cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit(', x"'))), F.when(F.col("f") % 3 == 0, "Key,Priority").when(F.col("f") % 3 == 1, "PRIORITY,other").otherwise("key , priority")).createOrReplaceTempView("order_files")
    return spark.sql("SELECT path, t.line, t.key, t.priority FROM order_files, LATERAL parse_csv(text, 'key', 'priority') AS t")


def xml_messages(spark, d):
    return _messages(spark, d).select("path", F.col("m.error").isNull().alias("whole"), "m.message_id", "m.version", "m.upc", "m.title", "m.label", F.get("m.tracks.isrc", F.lit(0)).alias("isrc"), F.get("m.deals.start_date", F.lit(0)).alias("deal_start"), F.get(F.get("m.deals.use_types", F.lit(0)), F.lit(0)).alias("deal_use"))


def xml_findings(spark, d):
    return SX.xml_findings(_messages(spark, d), "http://x/xml/ern/41").select("path", "rule_id", "severity", "field")


def scans_json(spark, d):
    r = T.results(spark, d).withColumn("message", F.col("layer"))
    scans = T.scans(spark, d).select("scan_id", "grade")
    return K.scans_json(scans, r)


def deliveries(spark, d):
    """Usage events to the endpoints that ask for them."""
    events = T.load(spark, d, "events").select((F.col("user_id") % 10).alias("org_id"), F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("payload"))
    ends = T.load(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("org_id"), F.col("s_name").alias("url"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("error"), F.lit("click"))).otherwise(F.array(F.lit("click"))).alias("events"), (F.col("s_suppkey") % 4 > 0).alias("active"))
    return K.deliveries(events, ends)


def live_tokens(spark, d):
    o = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_orderdate").alias("expires_at"))
    return K.live_tokens(o, F.lit("1998-08-02").cast("timestamp")).select("token")


def track_upsert(spark, d):
    """An order's tracks; half are delivered anew under another place, ISRC or title."""
    o = T.load(spark, d, "orders")
    k = F.col("o_orderkey")
    code = lambda n: F.concat(F.lit("USPR126"), F.lpad(n.cast("string"), 5, "0"))
    old = o.select(F.floor(k / 2).alias("release_id"), (k % 2 + 1).cast("int").alias("track_number"), code(k).alias("isrc"), F.concat(F.lit("t"), k.cast("string")).alias("title"), F.lit(1000).cast("long").alias("duration_ms"))
    place = F.when(k % 6 == 0, 9).when(k % 6 == 2, 1).otherwise(7).cast("int")
    isrc = F.when(k % 6 == 0, code(k)).when(k % 6 == 2, code(k + 50000))
    new = o.where(k % 2 == 0).select(F.floor(k / 2).alias("release_id"), place.alias("track_number"), isrc.alias("isrc"), F.when(k % 6 == 0, "").when(k % 6 == 2, "new").alias("title"), F.lit(2000).cast("long").alias("duration_ms"))
    return K.upsert_tracks(old, new)


_DATE = "strftime(try_strptime(substr(raw, 1, 4) || '20' || substr(raw, 5, 2), '%m%d%Y'), '%Y-%m-%d')"
_PICK = lambda n, *xs: "CASE " + n + " % " + str(len(xs)) + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
_CSV = f"""c AS (SELECT k, f, 'file-' || f || '.csv' AS path, trim(upc) AS upc, trim(title) AS title, rd, label, isrc, tn, duration, lower(ex) IN ('true', 'yes', '1') AS ex, row_number() OVER (PARTITION BY f ORDER BY k) + 1 AS line FROM (
 SELECT o_orderkey AS k, o_orderkey // 100 AS f, CASE WHEN o_orderkey % 30 < 27 THEN lpad((o_orderkey // 3 % 5000)::VARCHAR, CASE WHEN o_orderkey % 5 = 4 THEN 11 ELSE 12 END, '0') ELSE ' ' END AS upc, CASE WHEN o_orderkey % 4 > 0 THEN 'R, "x" ' || o_orderkey ELSE ' ' END AS title,
 {_PICK('o_orderkey', "'1/2/98'", "'2020-13-45'", "'2020'", "'2020-1'", "''", "strftime(o_orderdate, '%Y-%m-%d')")} AS rd, o_orderpriority AS label, {_PICK('o_orderkey', "''", "'bad'", "'us-pr1-26-00001'", "'US-PR126-00001'", "'USPR12600001'")} AS isrc, {_PICK('o_orderkey // 2', "'x'", "'+3'", "'1.5'", "''", "'1_0'", "'7'")} AS tn,
 CASE WHEN o_orderkey % 6 = 0 THEN '4m' WHEN o_orderkey % 6 = 1 THEN '1:2:3' WHEN o_orderkey % 7 = 2 THEN '' ELSE (o_orderkey % 10) || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') END AS duration, {_PICK('o_orderkey', "'TRUE'", "'no'", "'1'", "''")} AS ex FROM orders)),
g AS (SELECT * FROM c WHERE NOT ({_EMPTY}) AND NOT ({_LATIN}) AND NOT ({_SHORT}))"""
_JV = {"upc": "CASE WHEN k % 4 = 3 THEN '\"' || lpad(k::VARCHAR, 12, '0') || '\"' ELSE " + _PICK("k", "'\"\"'", "'\"abc\"'", "'123456789012'") + " END", "artist": _PICK("k", "'\"A\"'", "'\" \"'", "'0'", "'false'", "'\"B\"'"), "rd": _PICK("k // 7", "'\"2020-13-45\"'", "'\"2020/01/01\"'", "'\"\"'", "'\"2021-05-06\"'", "'20200101'"), "deals": _PICK("k // 11", "'[]'", "'[{\"territory\":\"DE\"},3]'", "'\"x\"'", "'null'")}
_JT = {"isrc": _PICK("k", "'\"USPR12600001\"'", "'\"us-pr1-26-00001\"'", "'null'", "'\"\"'", "'\"US-PR126-00001\"'"), "title": _PICK("k // 3", "'\"T\"'", "'\" \"'", "'0'", "'[]'"), "track_number": _PICK("k // 2", "'3'", "'\"4\"'", "'\"x\"'", "'null'", "'2.5'", "'[1]'", "'true'"), "duration_ms": _PICK("k // 5", "'1000'", "'\"1m\"'", "'{}'")}
_TRACK = " || ".join(f"'{',' if i else '{'}\"{n}\":' || {x}" for i, (n, x) in enumerate(_JT.items())) + " || '}'"
# The texts anew, taken apart by DuckDB's own JSON functions: t has a release each, u a track each.
_J = f"""s AS (SELECT k, CASE WHEN k % 20 = 0 THEN '{{' WHEN k % 20 = 1 THEN '[' || body || ',5,' || body || ']' WHEN k % 20 = 2 THEN '3' ELSE body END AS text FROM (
 SELECT k, '{{"upc":' || {_JV["upc"]} || ',"title":"R \\"q\\" ' || k || '","artist":' || {_JV["artist"]} || ',"label":"L","release_date":' || {_JV["rd"]} || ',"deals":' || {_JV["deals"]} || ',"tracks":' ||
 CASE k % 9 WHEN 0 THEN '[]' WHEN 1 THEN '{{"a":1}}' WHEN 2 THEN 'null' WHEN 3 THEN '[7,' || {_TRACK} || ',null]' ELSE '[' || {_TRACK} || ',' || {_TRACK} || ']' END || '}}' AS body FROM (SELECT o_orderkey AS k FROM orders))),
p AS (SELECT k, k::VARCHAR AS path, json_valid(text) AS fine, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM s),
t AS (SELECT path, i AS pos, r, json_type(r) = 'OBJECT' AS whole, 'releases[' || i || ']' AS fld FROM (SELECT path, unnest(CASE json_type(j) WHEN 'ARRAY' THEN j->'$[*]' ELSE [j] END) AS r, unnest(range(CASE json_type(j) WHEN 'ARRAY' THEN json_array_length(j)::BIGINT ELSE 1 END)) AS i FROM p WHERE fine AND json_type(j) IN ('OBJECT', 'ARRAY'))),
u AS (SELECT path, pos, fld || '.tracks[' || i || ']' AS fld, x, json_type(x) = 'OBJECT' AS whole FROM (SELECT path, pos, fld, unnest(r->'$.tracks[*]') AS x, unnest(range(json_array_length(r->'$.tracks')::BIGINT)) AS i FROM t WHERE whole AND json_type(r->'$.tracks') = 'ARRAY'))"""
_NOTHING = lambda v: f"(coalesce(json_type({v}), 'NULL') = 'NULL' OR ({v})::VARCHAR IN ('\"\"', '0', 'false', '[]', '{{}}', '0.0'))"
_ODD = lambda v, pattern: f"NOT {_NOTHING(v)} AND trim({v}->>'$') <> '' AND NOT regexp_full_match(trim({v}->>'$'), '{pattern}')"
_NO_INT = lambda v: f"json_type({v}) IN ('ARRAY', 'OBJECT') OR json_type({v}) = 'VARCHAR' AND NOT regexp_full_match(trim({v}->>'$'), '[+-]?[0-9]+(_[0-9]+)*')"
_FILE_ISRC = "[A-Z]{2}-?[A-Z0-9]{3}-?[0-9]{2}-?[0-9]{5}"


def _any(cases, source, columns):
    return " UNION ALL ".join(f"SELECT {columns}, '{rule}' AS rule_id, '{severity}' AS severity FROM {source} WHERE {where}" for rule, severity, where in cases)


_CSV_CHECKS = [
    ("csv.missing_upc", "error", "upc = ''", "NULL"), ("csv.upc_format", "error", "upc <> '' AND NOT regexp_full_match(upc, '[0-9]{12,13}')", "upc"), ("csv.isrc_format", "error", f"upc <> '' AND isrc <> '' AND NOT regexp_full_match(isrc, '{_FILE_ISRC}')", "isrc"),
    ("csv.date_format", "error", "upc <> '' AND rd <> '' AND NOT regexp_full_match(rd, '[0-9]{4}-[0-9]{2}-[0-9]{2}')", "rd"), ("csv.track_number", "error", "upc <> '' AND tn <> '' AND NOT regexp_full_match(tn, '[+-]?[0-9]+(_[0-9]+)*')", "tn"),
    ("csv.duration_format", "warning", "upc <> '' AND duration <> '' AND NOT regexp_full_match(duration, '[0-9]{1,3}:[0-9]{2}')", "duration"),
]
_CSV_FILES = [("csv.empty", _EMPTY), ("csv.encoding", f"NOT ({_EMPTY}) AND ({_LATIN})"), ("csv.missing_columns", f"NOT ({_EMPTY}) AND NOT ({_LATIN}) AND ({_SHORT})")]
_JSON_CHECKS = [
    *[(f"json.missing_{x}", "error", "t", f"whole AND {_NOTHING(f'r->' + chr(39) + '$.' + x + chr(39))}", x) for x in ("upc", "title", "artist", "label", "release_date")],
    ("json.release_type", "error", "t", "NOT whole", ""), ("json.upc_format", "error", "t", f"whole AND {_ODD("(r->'$.upc')", '[0-9]{12,13}')}", "upc"), ("json.date_format", "error", "t", f"whole AND {_ODD("(r->'$.release_date')", '[0-9]{4}-[0-9]{2}-[0-9]{2}')}", "release_date"),
    ("json.deals_type", "warning", "t", "whole AND json_type(r->'$.deals') NOT IN ('NULL', 'ARRAY')", "deals"), ("json.no_tracks", "error", "t", f"whole AND {_NOTHING("(r->'$.tracks')")}", "tracks"),
    ("json.tracks_type", "error", "t", f"whole AND NOT {_NOTHING("(r->'$.tracks')")} AND json_type(r->'$.tracks') <> 'ARRAY'", "tracks"), ("json.track_type", "error", "u", "NOT whole", ""),
    *[(f"json.track.missing_{x}", "error", "u", f"whole AND {_NOTHING(f'x->' + chr(39) + '$.' + x + chr(39))}", x) for x in ("isrc", "title")], ("json.track.isrc_format", "error", "u", f"whole AND {_ODD("(x->'$.isrc')", _FILE_ISRC)}", "isrc"),
    *[(f"json.track.{x}", "warning", "u", f"whole AND ({_NO_INT(f'(x->' + chr(39) + '$.' + x + chr(39) + ')')})", x) for x in ("track_number", "duration_ms")],
]
_XML_CHECKS = [
    ("ddex.xml.wellformed", "critical", "", "k % 10 = 0"), ("ddex.xml.namespace", "error", "", "k % 10 > 0 AND k % 3 = 0"), ("ddex.structure.missing_deallist", "critical", "DealList", "k % 10 > 0 AND k % 4 = 0"),
    ("ddex.header.missing_messagerecipient", "error", "MessageRecipient", "k % 10 > 0 AND k % 5 = 0"), ("ddex.metadata.isrc_format", "error", "isrc", "k % 10 > 0 AND k % 6 = 0"),
    ("ddex.metadata.missing_publisher", "error", "publisher", "k % 10 > 0 AND k % 7 <= 2"), ("ddex.metadata.upc_format", "error", "upc", "k % 10 > 0 AND k % 8 = 0"),
]
_ISRC = """i AS (SELECT c_custkey AS k, 'file-' || (c_custkey // 100) AS path, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey)::INT AS row_number, CASE WHEN c_custkey % 5 = 0 THEN 'BAD' WHEN c_custkey % 5 < 3 THEN 'us-pr1-26-' || lpad(c_custkey::VARCHAR, 5, '0') ELSE 'USPR126' || lpad(c_custkey::VARCHAR, 5, '0') END AS isrc,
 CASE WHEN c_custkey % 7 > 0 THEN c_name ELSE '' END AS artist, CASE WHEN c_custkey % 11 > 0 THEN c_mktsegment ELSE '' END AS title, CASE WHEN c_custkey % 6 = 0 THEN '13' ELSE lpad((c_custkey * 31 % 1000000)::VARCHAR, 6, '0') END AS raw, CASE WHEN c_custkey % 4 >= 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' ELSE 'AB' END END AS abbr,
 CASE WHEN c_custkey % 4 >= 2 THEN 'Lab' END AS label, CASE WHEN c_custkey % 4 = 3 THEN CASE c_custkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'ZZ' END END AS country FROM customer)"""
_ISRC_CHECKS = [
    ("ISRC_FORMAT", "critical", "k % 5 = 0"), ("ISRC_ARTIST_MISSING", "warning", "k % 7 = 0"), ("ISRC_TITLE_MISSING", "warning", "k % 11 = 0"), ("ISRC_DATE_FORMAT", "critical", "k % 6 = 0"), ("ISRC_LABEL_ABBR_INVALID", "warning", "len(abbr) > 10"),
    ("ISRC_COUNTRY_CODE_INVALID", "warning", "country = 'ZZ'"), ("ISRC_COUNTRY_CODE_MISSING", "warning", "country IS NULL"),
]

QUERIES = {
    "bulk_file_scan": (bulk_file_scan, f"""WITH p AS (SELECT p_partkey AS k, p_partkey // 100 AS f, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS rn, lpad((p_partkey * 31 % 1000000)::VARCHAR, 6, '0') AS raw, p_brand, p_name FROM part)
        SELECT 'file-' || f AS path, rn::INT AS row_number, lpad(k::VARCHAR, 13, '0') AS ean, CASE WHEN f % 2 = 1 THEN p_brand || ', ' || k ELSE p_brand END AS artist, p_name AS title, raw AS release_date_raw, {_DATE} AS release_date, CASE WHEN k % 4 = 0 THEN 'Imp' END AS imprint,
        CASE WHEN k % 6 > 0 THEN 'Lab' END AS label, '00' AS narm_config, CASE WHEN f % 4 < 3 THEN 'AB' END AS label_abbreviation, CASE WHEN f % 4 < 3 THEN 'US' END AS country_code, CASE WHEN f % 4 = 3 OR k % 3 = 0 THEN lpad(k::VARCHAR, 16, '0') END AS isni,
        CASE WHEN f % 4 = 3 OR k % 5 = 0 THEN 'T' || lpad(k::VARCHAR, 10, '0') END AS iswc FROM p WHERE k % 10 < 8"""),
    "isrc_file_scan": (isrc_file_scan, f"WITH {_ISRC} SELECT path, row_number, isrc, artist, title, raw AS release_date_raw, CASE WHEN len(raw) = 6 THEN {_DATE} END AS release_date, abbr AS label_abbreviation, label AS label_name, country AS country_code FROM i"),
    "isrc_file_checks": (isrc_file_checks, f"WITH {_ISRC} {_any(_ISRC_CHECKS, 'i', 'path, row_number')}"),
    "csv_releases": (csv_releases, f"""WITH {_CSV}, t AS (SELECT *, line || ':' || isrc || ':' || CASE WHEN regexp_full_match(tn, '[+-]?[0-9]+(_[0-9]+)*') THEN replace(tn, '_', '')::BIGINT::VARCHAR ELSE '?' END || ':' || CASE WHEN regexp_full_match(duration, '[0-9]{{1,3}}:[0-9]{{2}}') THEN ((split_part(duration, ':', 1)::INT * 60 + split_part(duration, ':', 2)::INT) * 1000)::VARCHAR ELSE '?' END || ':' || CASE WHEN ex THEN 'E' ELSE '-' END AS track FROM g WHERE upc <> '')
        SELECT path, upc, arg_min(title, k) AS title, 'A' AS artist, arg_min(label, k) AS label, arg_min(rd, k) AS release_date, 'Album' AS release_type, string_agg(track, '|' ORDER BY k) AS tracks, coalesce(string_agg(nullif(isrc, ''), '|' ORDER BY k), '') AS isrcs FROM t GROUP BY path, upc"""),
    "csv_findings": (csv_findings, f"WITH {_CSV} " + " UNION ALL ".join(f"SELECT path, line, '{rule}' AS rule_id, '{severity}' AS severity, {actual} AS actual FROM g WHERE {where}" for rule, severity, where, actual in _CSV_CHECKS)
        + "".join(f" UNION ALL SELECT DISTINCT path, NULL::BIGINT, '{rule}', 'critical', NULL FROM c WHERE {where}" for rule, where in _CSV_FILES) + " UNION ALL SELECT path, NULL, 'csv.missing_release_title', 'error', upc FROM g WHERE upc <> '' GROUP BY path, upc HAVING arg_min(title, k) = ''"),
    "json_releases": (json_releases, f"""WITH {_J}, w AS (SELECT path, pos, string_agg(CASE WHEN {_NOTHING("(x->'$.isrc')")} OR trim(x->>'$.isrc') = '' THEN '?' ELSE x->>'$.isrc' END || ':' || CASE WHEN coalesce(trim(x->>'$.title'), '') = '' THEN '?' ELSE trim(x->>'$.title') END || ':' || coalesce(CASE json_type(x->'$.track_number') WHEN 'VARCHAR' THEN try_cast(x->>'$.track_number' AS INT) WHEN 'BOOLEAN' THEN 1 WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL ELSE trunc((x->>'$.track_number')::DOUBLE)::INT END::VARCHAR, '?') || ':' || coalesce(try_cast(x->>'$.duration_ms' AS BIGINT)::VARCHAR, '?'), '|' ORDER BY fld) AS tracks FROM u WHERE whole GROUP BY path, pos)
        SELECT path, pos::INT AS pos, CASE WHEN NOT {_NOTHING("(r->'$.upc')")} THEN trim(r->>'$.upc') END AS upc, r->>'$.title' AS title, CASE WHEN NOT {_NOTHING("(r->'$.artist')")} THEN trim(r->>'$.artist') END AS artist, CASE WHEN NOT {_NOTHING("(r->'$.release_date')")} THEN r->>'$.release_date' END AS release_date,
        CASE WHEN json_type(r->'$.deals') = 'ARRAY' THEN (SELECT count(*) FROM (SELECT unnest(r->'$.deals[*]') AS e) WHERE json_type(e) = 'OBJECT') ELSE -1 END::INT AS n_deals, coalesce(tracks, '') AS tracks FROM t LEFT JOIN w USING (path, pos) WHERE whole"""),
    "json_findings": (json_findings, f"WITH {_J} " + " UNION ALL ".join(f"SELECT path, '{rule}' AS rule_id, '{severity}' AS severity, fld || '{'.' + x if x else ''}' AS field FROM {source} WHERE {where}" for rule, severity, source, where, x in _JSON_CHECKS)
        + " UNION ALL SELECT path, 'json.parse', 'critical', '' FROM p WHERE NOT fine UNION ALL SELECT path, 'json.structure', 'critical', '' FROM p WHERE fine AND json_type(j) NOT IN ('OBJECT', 'ARRAY')"),
    "xml_messages": (xml_messages, """SELECT o_orderkey::VARCHAR AS path, o_orderkey % 10 > 0 AS whole, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey::VARCHAR END AS message_id, CASE WHEN o_orderkey % 10 > 0 AND o_orderkey % 3 > 0 THEN '41' END AS version,
        CASE WHEN o_orderkey % 10 > 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'bad' ELSE lpad(o_orderkey::VARCHAR, 12, '0') END END AS upc, CASE WHEN o_orderkey % 10 > 0 THEN 'R & ' || o_orderkey END AS title, CASE WHEN o_orderkey % 10 > 0 THEN o_orderpriority END AS label,
        CASE WHEN o_orderkey % 10 > 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'BAD' ELSE 'USPR126' || lpad(o_orderkey::VARCHAR, 5, '0') END END AS isrc, CASE WHEN o_orderkey % 10 > 0 AND o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS deal_start,
        CASE WHEN o_orderkey % 10 > 0 AND o_orderkey % 4 > 0 THEN 'Stream' END AS deal_use FROM orders"""),
    "xml_findings": (xml_findings, " UNION ALL ".join(f"SELECT k::VARCHAR AS path, '{rule}' AS rule_id, '{severity}' AS severity, '{field}' AS field FROM (SELECT o_orderkey AS k FROM orders) WHERE {where}" for rule, severity, field, where in _XML_CHECKS)),
    "message_tracks": (message_tracks, """SELECT o_orderkey::VARCHAR AS path, o_orderkey % 10 > 0 AS whole, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey::VARCHAR END AS message_id, CASE WHEN o_orderkey % 10 > 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'bad' ELSE lpad(o_orderkey::VARCHAR, 12, '0') END END AS upc,
        CASE WHEN o_orderkey % 10 > 0 THEN 0 END AS pos, CASE WHEN o_orderkey % 10 > 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'BAD' ELSE 'USPR126' || lpad(o_orderkey::VARCHAR, 5, '0') END END AS isrc, CASE WHEN o_orderkey % 10 > 0 THEN 'S ' || o_orderkey END AS title, CASE WHEN o_orderkey % 10 > 0 AND o_orderkey % 7 > 2 THEN 'P' END AS publisher FROM orders"""),
    "csv_lateral": (csv_lateral, """SELECT 'file-' || (o_orderkey // 100) AS path, row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) + 1 AS line, CASE WHEN o_orderkey // 100 % 3 <> 1 THEN o_orderkey::VARCHAR END AS key,
        CASE WHEN o_orderkey // 100 % 3 = 1 THEN o_orderkey::VARCHAR ELSE o_orderpriority || ', x' END AS priority FROM orders"""),
    "scans_json": (scans_json, f"""WITH {T.RESULTS}, {T.SCANS}, f AS (SELECT scan_id, list({{'severity': severity, 'rule_id': rule_id, 'layer': layer, 'message': layer}} ORDER BY severity, rule_id, layer) AS results FROM results GROUP BY 1)
        SELECT scan_id, to_json({{'scan_id': scan_id, 'grade': grade, 'results': coalesce(results, [])}})::VARCHAR AS document FROM scans LEFT JOIN f USING (scan_id)"""),
    "webhook_deliveries": (deliveries, """SELECT e.user_id % 10 AS org_id, s_name AS url, event_type AS event, event_id::VARCHAR AS payload FROM events e JOIN supplier ON e.user_id % 10 = s_suppkey % 10 AND s_suppkey % 4 > 0
        WHERE event_type = 'click' OR (event_type = 'error' AND s_suppkey % 3 = 0)"""),
    "live_tokens": (live_tokens, "SELECT o_orderkey AS token FROM orders WHERE o_orderdate > TIMESTAMP '1998-08-02'"),
    "track_upsert": (track_upsert, """WITH o AS (SELECT o_orderkey AS k, o_orderkey // 2 AS release_id, 'USPR126' || lpad(o_orderkey::VARCHAR, 5, '0') AS isrc FROM orders)
        SELECT release_id, (k % 2 + 1)::INT AS track_number, CASE WHEN k % 6 = 2 THEN 'USPR126' || lpad((k + 50000)::VARCHAR, 5, '0') ELSE isrc END AS isrc, CASE WHEN k % 6 = 2 THEN 'new' ELSE 't' || k END AS title, 1000::BIGINT AS duration_ms FROM o
        UNION ALL SELECT release_id, 7, NULL, 'Unknown', 2000::BIGINT FROM o WHERE k % 6 = 4"""),
}
