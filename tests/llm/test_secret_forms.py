"""Secrets and harmless look-alikes written out here, in forms of their own: what the scan finds by form."""

import random
import string

import pytest
from pyspark.sql import functions as F

from tonearm.llm import secrets as S

ALNUM, HEX = string.ascii_letters + string.digits, "0123456789abcdef"
r = random.Random(99)


def some(alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


SECRETS = {
    "key pair": lambda: f"aws_secret_access_key = {some(ALNUM + '/+', 40)}", "key id": lambda: "AKIA" + some(string.ascii_uppercase + "234567", 16), "in a sentence": lambda: f"remote ghp_{some(ALNUM, 36)} used",
    "chat token": lambda: f"xoxb-{some(string.digits, 12)}-{some(string.digits, 12)}-{some(ALNUM, 24)}", "payment key": lambda: "STRIPE=sk_live_" + some(ALNUM, 24), "bearer": lambda: f"Authorization: Bearer eyJ{some(ALNUM, 20)}.eyJ{some(ALNUM, 40)}.{some(ALNUM + '-_', 43)}",
    "map key": lambda: "key AIza" + some(ALNUM + "-_", 35), "registry": lambda: "//registry/:_authToken=npm_" + some(ALNUM, 36), "config": lambda: f"db_password: {some(ALNUM + '!#%', 14)}", "json": lambda: f'{{"client_secret": "{some(ALNUM, 32)}"}}', "hex": lambda: "api_key=" + some(HEX, 32),
    "bare": lambda: f"my key is {some(ALNUM, 40)} keep it", "shell": lambda: f"export TOKEN='{some(ALNUM, 24)}'", "private key": lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(some(ALNUM + "+/", 64) for _ in range(4)) + "\n-----END RSA PRIVATE KEY-----",
}
HARMLESS = {
    "uuid": lambda: f"request id {some(HEX, 8)}-{some(HEX, 4)}-4{some(HEX, 3)}-a{some(HEX, 3)}-{some(HEX, 12)} done", "commit": lambda: f"commit {some(HEX, 40)} merged", "digest": lambda: f"sha256: {some(HEX, 64)}", "etag": lambda: f"ETag: {some(HEX, 32)}",
    "path": lambda: f"see /usr/local/lib/python3.{r.randint(1, 9)}/site-packages/numpy/core/arrays_{r.randint(1, 99)}.py", "address": lambda: f"https://example.org/articles/2023/0{r.randint(1, 9)}/how-to-bake-bread-{r.randint(100, 999)}.html", "isbn": lambda: f"ISBN 978-3-{some(string.digits, 2)}-{some(string.digits, 6)}-1",
    "phone": lambda: f"call +49-{some(string.digits, 4)}-{some(string.digits, 8)}", "word": lambda: r.choice(["Donaudampfschifffahrtsgesellschaft", "internationalization2", "BundesverfassungsGericht"]), "snake": lambda: f"max_connection_pool_size_{r.randint(1, 99)} = default_value_for_pool", "camel": lambda: f"getConnectionPoolManagerFactory{r.randint(1, 9)}()",
    "placeholder": lambda: r.choice(["password = your_password_here", "api_key: example_api_key_1", "token=changeme-changeme", "secret: <your secret goes here>"]), "date": lambda: f"2023-01-{r.randint(10, 28)}T12:{r.randint(10, 59)}:00.000Z logged", "version": lambda: f"build-2023.{r.randint(1, 12)}.{r.randint(1, 30)}-release-candidate{r.randint(1, 9)}",
    "order": lambda: f"order number {some(string.digits, 18)}",
}
WORDS = "the house and of reading many people in words under river stone light".split()


@pytest.fixture(scope="module")
def model(spark):
    return S.fit(S.labelled_findings(spark))


def test_secrets_by_form(spark, model):
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(label, form, f"{prose(6)} {make()} {prose(5)}") for label, forms in ((1, SECRETS), (0, HARMLESS)) for form, make in forms.items() for _ in range(30)]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, label int, form string, text string")
    found = S.scan(docs, model, keep=["id"]).where("is_secret").select("id").distinct().withColumn("hit", F.lit(1.0))
    share = {(x["label"], x["form"]): x["share"] for x in docs.join(found, "id", "left").groupBy("label", "form").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share")).collect()}
    assert {k: v for k, v in share.items() if k[0] == 1 and v < 0.9} == {} and {k: v for k, v in share.items() if k[0] == 0 and v > 0.1} == {}


def test_secrets_planted_in_the_documents(spark, model):
    """Every assigned token of 40 hexadecimal digits in the driver's documents is found, and nothing of its numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1))).alias("candidate"))
    found = S.scan(docs, model, keep=["doc_id"]).where("is_secret").select("doc_id", "candidate")
    assert planted.count() > 0 and planted.exceptAll(found).count() == 0 and found.where("candidate rlike '^[0-9]+$'").count() == 0
