"""Signed notices: their body and its HMAC-SHA256 signature, on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_BLOCK = 64  # bytes of a SHA-256 block


def hmac_sha256(secret: Column, payload: Column) -> Column:
    """Hex signature of a payload; null secret or payload: null. Two rounds of SHA-256 over the secret, padded to a block and mixed with a byte, and what goes before."""
    key = F.encode(secret, "utf-8")
    key = F.when(F.octet_length(key) > _BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)
    digits = F.rpad(F.hex(key), 2 * _BLOCK, "0")

    def mixed(byte: int) -> Column:
        one = lambda i: F.lpad(F.hex(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte))), 2, "0")
        return F.when(secret.isNotNull(), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_BLOCK - 1)), one), "")))

    inner = F.sha2(F.concat(mixed(0x36), F.encode(payload, "utf-8")), 256)
    return F.sha2(F.concat(mixed(0x5C), F.unhex(inner)), 256)


def callback_payload(event_id: Column, task_id: Column, status: Column, result: Column, error: Column) -> Column:
    """Body of a notice; keys without a value are left out."""
    return F.to_json(F.struct(event_id.alias("event_id"), task_id.alias("task_id"), status.alias("status"), result.alias("result_path"), error.alias("error_message")), {"ignoreNullFields": "true"})


def signed(outbox: DataFrame, payload: Column, secret: Column) -> DataFrame:
    return outbox.withColumn("payload_json", payload).withColumn("signature", F.concat(F.lit("sha256="), hmac_sha256(secret, F.col("payload_json"))))


def signature_valid(payload: Column, secret: Column, signature: Column) -> Column:
    return F.coalesce(F.concat(F.lit("sha256="), hmac_sha256(secret, payload)) == signature, F.lit(False))
