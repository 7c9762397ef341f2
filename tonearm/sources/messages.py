"""Release messages (XML): one walk over the document, one projection for all findings, and table functions for SQL."""

from __future__ import annotations

import functools
import re
import xml.etree.ElementTree as ET
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions import identifiers as I
from ..operators.findings import explode_findings, finding
from ..schema import FINDING

XML_RELEASE = (
    "struct<error:string,namespace:string,message_id:string,missing:array<string>,upc:string,title:string,artist:string,label:string,release_date:string,genre:string,"
    "c_line:string,p_line:string,parental_warning:string,upcs:array<string>,tracks:array<struct<isrc:string,title:string,duration:string,publisher:string,artist:string>>,"
    "deals:array<struct<release_reference:string,commercial_model:string,start_date:string,end_date:string,territory:string,use_types:array<string>>>,version:string,"
    "ern_version:string,profile:string,artwork_width:int,artwork_height:int>"
)
# Sections and headers that a message must have, and versions by namespace.
SECTIONS = ("MessageHeader", "ResourceList", "ReleaseList", "DealList")
HEADERS = ("MessageId", "MessageSender", "MessageRecipient", "MessageCreatedDateTime")
VERSIONS = {"http://ddex.net/xml/ern/43": "ERN43", "http://ddex.net/xml/ern/42": "ERN42", "http://ddex.net/xml/ern/382": "ERN382"}


@functools.lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class Message:
    """All elements of a document in its order, by local name, with their texts and places; a region is an element's span."""

    def __init__(self, root):
        self.names, self.elements, self.ends, self.ups = [], [], [], []
        self.at: dict[str, list[int]] = defaultdict(list)
        self._walk(root)

    def _walk(self, root) -> None:
        todo = [(root, -1)]
        while todo:
            node, up = todo.pop()
            if node is None:  # an element's end
                self.ends[up] = len(self.names)
                continue
            i = len(self.names)
            name = _local(node.tag) if isinstance(node.tag, str) else ""
            self.names.append(name)
            self.elements.append(node)
            self.ends.append(i + 1)
            self.ups.append(up)
            self.at[name].append(i)
            if len(node):
                todo.append((None, i))
                todo += [(child, i) for child in reversed(node)]

    def all(self, region: int, name: str) -> list[int]:
        """Elements of a name from a region's own on, in order."""
        spots = self.at.get(name, ())
        return list(spots[bisect_right(spots, region - 1) : bisect_right(spots, self.ends[region] - 1)])

    def text(self, i: int) -> str:
        return (self.elements[i].text or "").strip()

    def find(self, region: int | None, *path: str) -> str | None:
        """The first text that isn't blank below a region along names, other elements between them."""
        if region is None:
            return None
        for i in self.all(region, path[-1]):
            if i != region and (value := self.text(i)):
                want, up = len(path) - 2, self.ups[i]
                while want >= 0 and up > region:
                    want -= self.names[up] == path[want]
                    up = self.ups[up]
                if want < 0:
                    return value
        return None

    def first(self, region: int | None, name: str) -> int | None:
        return next((i for i in self.all(region, name)), None) if region is not None else None


def _deal(m: Message, i: int) -> dict:
    """Reference, model, dates, territory and uses of a deal of a release."""
    terms = m.first(i, "DealTerms")
    return {
        "release_reference": m.find(i, "DealReleaseReference"), "commercial_model": m.find(terms, "CommercialModelType"), "start_date": m.find(terms, "ValidityPeriod", "StartDate"),
        "end_date": m.find(terms, "ValidityPeriod", "EndDate"), "territory": m.find(terms, "TerritoryCode"), "use_types": [m.text(u) for u in m.all(i, "UseType") if m.text(u)],
    }


def _track(m: Message, i: int) -> dict:
    publisher = m.find(i, "DisplayPublisher")
    for k in m.all(i, "Contributor") if not publisher else []:
        roles = [m.elements[r] for r in range(k, m.ends[k]) if "Role" in m.names[r]]
        if any("MusicPublisher" in ((r.text or "") + "".join(r.attrib.values())) for r in roles):
            publisher = m.find(k, "FullName") or "MusicPublisher"
    return {"isrc": m.find(i, "ISRC") or m.find(i, "IsRC"), "title": m.find(i, "TitleText"), "duration": m.find(i, "Duration"), "publisher": publisher, "artist": m.find(i, "DisplayArtist", "FullName") or m.find(i, "DisplayArtistName")}


def _artwork(m: Message) -> dict:
    """Width and height of the first front or cover image that tells one."""
    for i in m.all(0, "Image"):
        kind = (m.find(i, "ImageType") or "").lower()
        if not kind or "front" in kind or "cover" in kind:
            size = {side: m.find(i, f"Image{side.title()}") for side in ("width", "height")}
            whole = {f"artwork_{side}": int(v) for side, v in size.items() if v and re.fullmatch("[+-]?[0-9]{1,9}", v)}
            if whole:
                return whole
    return {}


def parse_message(text: str | None) -> dict:
    """What a release message says. Documents with a DTD are refused, so that no entity is resolved."""
    empty = dict.fromkeys(("error", "namespace", "message_id", "upc", "title", "artist", "label", "release_date", "genre", "c_line", "p_line", "parental_warning", "ern_version", "profile", "artwork_width", "artwork_height"))
    empty |= {"missing": [], "upcs": [], "tracks": [], "deals": [], "version": None}
    if not (text or "").strip():
        return empty | {"error": "empty"}
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return empty | {"error": "DTD is not allowed"}
    try:
        root = ET.fromstring(text.encode())
    except (ET.ParseError, ValueError) as e:
        return empty | {"error": str(e)}
    m = Message(root)
    namespace = root.tag[1:].split("}")[0] if root.tag.startswith("{") else None
    releases = m.all(0, "Release")
    main = next((r for r in releases if m.elements[r].get("IsMainRelease") == "true"), releases[0] if releases else None)
    spots = m.all(main, "ReleaseDetailsByTerritory") if main is not None else []
    spot = next((s for s in spots if m.find(s, "TerritoryCode") in ("Worldwide", "WW", "001")), spots[0] if spots else main)
    first = lambda *paths: next((v for n in (spot, main) for p in paths if (v := m.find(n, *p))), None)
    return empty | {
        "namespace": namespace, "ern_version": VERSIONS.get(namespace, "unknown"), "profile": next((v for r in releases if (v := m.find(r, "ReleaseType"))), None),
        "message_id": m.find(0, "MessageId"), "missing": [s for s in (*SECTIONS, *HEADERS) if s not in m.at],
        "upc": next((v for p in ("ICPN", "UPC") if (v := m.find(main, p))), None), "title": first(("ReferenceTitle", "TitleText"), ("TitleText",)), "artist": first(("DisplayArtistName",), ("DisplayArtist", "FullName")),
        "label": first(("LabelName",)), "release_date": first(("OriginalReleaseDate",), ("ReleaseDate",), ("GlobalReleaseDate",)), "genre": first(("GenreText",)), "c_line": first(("CLineText",)), "p_line": first(("PLineText",)),
        "parental_warning": first(("ParentalWarningType",)), "upcs": [m.text(u) for u in m.all(0, "UPC")], "tracks": [_track(m, i) for i in m.all(0, "SoundRecording")], "deals": [_deal(m, i) for i in m.all(0, "ReleaseDeal")],
        "version": next((x for x in (root.get("MessageSchemaVersionId"), root.get("ReleaseProfileVersionId")) if x), None) or (re.search(r"ern/([0-9/]+)", root.tag) or [None, None])[1],
    } | _artwork(m)


def parse_xml(text):
    """Messages as structs: Spark's own XML functions stop at malformed input and don't tell namespaces."""

    kind = to_arrow_type(DataType.fromDDL(XML_RELEASE))

    @F.arrow_udf(XML_RELEASE)
    def parse(texts: pa.Array) -> pa.Array:
        return pa.array([parse_message(t) for t in texts.to_pylist()], kind)

    return parse(text)


def xml_findings(messages: DataFrame, namespace: str | None = None) -> DataFrame:
    """messages: path, m (of parse_xml). All findings of a message in one projection and one explode, so that it is parsed once."""
    m = lambda name: F.col(f"m.{name}")
    whole = m("error").isNull()
    section = lambda x: x.isin(*SECTIONS)
    own = [
        finding(m("error").isNotNull(), "ddex.xml.wellformed", "critical", F.concat(F.lit("not well-formed: "), m("error"))),
        finding(whole & m("namespace").isNull(), "ddex.xml.namespace", "error", "no namespace"),
        finding(whole & F.lit(namespace is not None) & (m("namespace") != F.lit(namespace or "")), "ddex.xml.namespace_mismatch", "error", "other namespace", "", m("namespace")),
    ]
    gone = lambda x: F.struct(F.concat(F.when(section(x), "ddex.structure.missing_").otherwise("ddex.header.missing_"), F.lower(x)).alias("rule_id"), F.when(section(x), "critical").otherwise("error").alias("severity"), F.concat(x, F.lit(" is missing")).alias("message"), x.alias("field"), F.lit(None).cast("string").alias("actual")).cast(FINDING)
    of_track = lambda t: F.array_compact(F.array(
        finding(~I.blank(t["isrc"]) & ~I.isrc_valid(t["isrc"]), "ddex.metadata.isrc_format", "error", "ISRC is not CC-XXX-YY-NNNNN", "isrc", t["isrc"]), finding(I.blank(t["publisher"]), "ddex.metadata.missing_publisher", "error", "track has no publisher", "publisher", t["title"]),
    ))
    of_upc = lambda u: finding(~u.rlike(I.UPC), "ddex.metadata.upc_format", "error", "UPC is not 12 or 13 digits", "upc", u)
    found = F.concat(F.array_compact(F.array(*own)), F.transform(m("missing"), gone), F.flatten(F.transform(m("tracks"), of_track)), F.array_compact(F.transform(m("upcs"), of_upc)))
    found = F.when(whole, found).otherwise(F.array_compact(F.array(own[0])))
    return messages.select("path", F.explode(found).alias("f")).select("path", "f.*")


# ------------------------------------------------------------------ table functions
def register_table_functions(spark: SparkSession) -> None:
    """parse_message(text), parse_csv(text, column...) and parse_json(text), for FROM files, LATERAL f(text) in SQL: a row a track, a record, a release."""
    from pyspark.sql.functions import AnalyzeResult, udtf
    from pyspark.sql.types import LongType, StringType, StructType

    track = ("isrc", "title", "duration", "publisher", "artist")

    @udtf(returnType="error string, message_id string, upc string, release_title string, label string, pos int, isrc string, title string, duration string, publisher string, artist string")
    class ParseMessage:
        """A row a track with what its message says; a message without tracks, or that is broken, has one row."""

        def eval(self, text: str):
            m = parse_message(text)
            for i, t in enumerate(m["tracks"] or [{}]):
                yield (m["error"], m["message_id"], m["upc"], m["title"], m["label"], i if t else None, *[t.get(k) for k in track])

    @udtf
    class ParseCsv:
        """A row a record with the columns named, by header without case; `line` is the record's number, the header's is 1."""

        @staticmethod
        def analyze(text, *columns) -> AnalyzeResult:
            names = [c.value for c in columns]
            if not names or not all(isinstance(n, str) for n in names):
                raise ValueError("name the columns as constant texts")
            schema = StructType().add("line", LongType())
            for n in names:
                schema = schema.add(n, StringType())
            return AnalyzeResult(schema=schema)

        def eval(self, text: str, *columns):
            import csv
            import io

            rows = csv.reader(io.StringIO((text or "").lstrip("﻿"), newline=""))
            header = [h.strip().lower() for h in next(rows, [])]
            spots = [header.index(c.lower()) if c.lower() in header else None for c in columns]
            for line, cells in enumerate((r for r in rows if r), 2):
                yield (line, *[cells[s].strip() if s is not None and s < len(cells) else None for s in spots])

    @udtf(returnType="error string, pos int, upc string, title string, artist string, n_tracks int, isrcs array<string>")
    class ParseJson:
        """A row a release of an object or an array of them."""

        def eval(self, text: str):
            import json

            try:
                given = json.loads((text or "").lstrip("﻿"))
            except ValueError as e:
                yield (str(e), None, None, None, None, None, None)
                return
            for i, r in enumerate(given if isinstance(given, list) else [given]):
                if not isinstance(r, dict):
                    yield ("not an object", i, None, None, None, None, None)
                    continue
                tracks = [t for t in r["tracks"] if isinstance(t, dict)] if isinstance(r.get("tracks"), list) else []
                plain = lambda v: None if v in (None, "", 0, False) or v == [] or v == {} else str(v).strip()
                yield (None, i, *[plain(r.get(k)) for k in ("upc", "title", "artist")], len(tracks), [c for t in tracks if (c := plain(t.get("isrc")))])

    for name, function in (("parse_message", ParseMessage), ("parse_csv", ParseCsv), ("parse_json_releases", ParseJson)):
        spark.udtf.register(name, function)
