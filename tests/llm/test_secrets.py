"""Private keys are found from BEGIN to END, in whatever form they are written."""

from pyspark.sql import functions as F

from sparkloom.llm import secrets
from sparkloom.llm.common import shared_folder

BODY = "MIIEpAIBAAKCAQEA7Zk+/q==".replace("=", "") * 3


def pem(*lines, end="\n", label="RSA PRIVATE KEY"):
    return end.join([f"-----BEGIN {label}-----", *lines, f"-----END {label}-----"])


def test_private_keys_go_whole(spark):
    keys = [
        pem("Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF", "", BODY, BODY),
        pem(BODY, BODY, end="\\n"),
        pem(BODY, BODY, end="\\r\\n", label="PRIVATE KEY"),
        pem(BODY, BODY, end='\\n" +\n    "'),
        pem(BODY, label="OPENSSH PRIVATE KEY"),
    ]
    texts = [f"before {k} after" for k in keys] + ["before " + " between ".join(keys) + " after"]
    texts.append(f"-----BEGIN PRIVATE KEY-----\n{BODY}\n: no end")
    texts.append("-----BEGIN PRIVATE KEY----- is a mark; " + keys[0])
    texts.append(f"-----BEGIN EC PRIVATE KEY-----\n{BODY}\n-----END PRIVATE KEY----- after")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.scan_secrets(df, shared_folder(spark, "test-pem"))
    got = [r[0] for r in found.orderBy("doc_id").select(secrets.redact("text", F.filter("secrets", lambda s: s["kind"] == "pem"))).collect()]
    assert got[: len(keys)] == ["before [SECRET] after"] * len(keys)
    assert got[len(keys)] == "before " + " between ".join(["[SECRET]"] * len(keys)) + " after"
    assert got[len(keys) + 1 :] == ["[SECRET]: no end", "[SECRET]; [SECRET]", "[SECRET] after"]
