"""A private key is found and replaced with its body."""

import pytest

from voxmill.llm import secret_scan

BODY = "\n".join(["MIIEpAIBAAKCAQEA7bq+Zx/Qw9Lk2TtY4uV8nR1sPqXmGhJdKfCzWvBnMlOiUyTr"] * 4 + ["Qw9Lk2T="])
HEAD = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D\n\n"


@pytest.mark.parametrize("kind", ["", "RSA ", "OPENSSH "])
@pytest.mark.parametrize("head, sep", [("", "\n"), (HEAD, "\n"), ("", "\r\n"), ("", "\\n")])
def test_whole_key(spark, kind, head, sep):
    key = f"-----BEGIN {kind}PRIVATE KEY-----\n{head}{BODY}\n-----END {kind}PRIVATE KEY-----".replace("\n", sep)
    text = f"é before\n{key}\nwords after it\n{key} end"
    scanner = secret_scan.scanner_of(secret_scan.RULES)
    assert [text[a:b] for k, a, b in secret_scan.text_spans(scanner, text) if k == "private_key"] == [key, key]
    cut = f"x: {key.split('-----END')[0]}"
    data = spark.createDataFrame([(1, text), (2, cut)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secret_scan.redact(data).collect()}
    assert clean == {1: "é before\n<secret>\nwords after it\n<secret> end", 2: "x: <secret>"}
