"""Handovers, custody, agent actions and verification that fails closed."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.operators import agent, custody, evidence
from tests.test_operators import bundle

PEMS = ["-----BEGIN PUBLIC KEY-----\nold\n-----END PUBLIC KEY-----\n", "-----BEGIN PUBLIC KEY-----\nnew\n-----END PUBLIC KEY-----\n"]
OLD, NEW = map(custody.key_id, PEMS)
RECORD = {
    "format": "issuer" + V.HANDOVER_FORMAT, "retiring_key_id": OLD, "successor_key_id": NEW, "retiring_public_key_pem": PEMS[0],
    "successor_public_key_pem": PEMS[1], "install_id": "i", "rotated_at": "t", "reason": "r",
}
ROW = {"retiring_key_id": OLD, "successor_key_id": NEW, "record": RECORD, "retiring_sig": "a", "successor_sig": "b"}
KEYS = [{"key_id": OLD, "public_key_pem": PEMS[0]}, {"key_id": NEW, "public_key_pem": PEMS[1].replace("\n", "\r\n")}]


def test_a_sound_handover():
    assert custody.handover_problem(ROW) is None
    out = custody.check_custody({}, False, KEYS, [ROW])
    assert out.error is None and out.rotations_checked == 0 and out.explained == {OLD, NEW}
    assert any("not verified (cryptography missing)" in w for w in out.warnings)
    out = custody.check_custody({}, False, KEYS, [ROW], lambda pem, digest, sig: sig in "ab")
    assert (out.error, out.rotations_checked, out.explained) == (None, 1, {OLD, NEW})
    assert "retiring" in custody.check_custody({}, False, KEYS, [ROW], lambda *_: False).error
    other = [{"key_id": OLD, "public_key_pem": "x"}]
    assert OLD in custody.check_custody({}, False, other, [ROW], lambda *_: True).error
    alone = custody.check_custody({}, False, [], [ROW], lambda *_: True)
    assert alone.error is None and not alone.explained and "cannot be tied" in alone.warnings[-1]


@pytest.mark.parametrize(
    "row,said",
    [
        (3, "malformed"), (None, "malformed"), ([], "malformed"), ({}, "no record"), (ROW | {"x": 1}, "allowlist: x"), (ROW | {"record": [1]}, "no record"),
        (ROW | {"record": RECORD | {"format": "z"}}, "unknown key handover format 'z'"), (ROW | {"record": RECORD | {"y": 1}}, "allowlist: y"),
        (ROW | {"record": RECORD | {"retiring_key_id": 5}}, "names no"), (ROW | {"record": RECORD | {"successor_key_id": OLD}}, "own successor"),
        (ROW | {"record": RECORD | {"retiring_public_key_pem": ""}}, "no retiring public key"), (ROW | {"record": RECORD | {"successor_public_key_pem": "q"}}, "successor public key does not hash"),
    ],
)
def test_odd_handovers_fail_and_never_raise(row, said):
    assert said in custody.check_custody({}, False, KEYS, [row]).error


def test_the_manifest_binds_keys_and_handovers():
    digest = custody.rotations_digest([ROW])
    assert custody.check_custody({"rotations_digest": digest, "key_ids": [OLD]}, True, KEYS, [ROW]).error is None
    assert "rotations_digest mismatch" in custody.check_custody({"rotations_digest": digest}, True, KEYS, []).error
    assert "gone" in custody.check_custody({"key_ids": [OLD, "gone"]}, True, KEYS, []).error
    assert custody.check_custody({"rotations_digest": digest}, False, KEYS, []).error is None
    assert custody.rotations_digest([ROW, 3]) == custody.rotations_digest([3, ROW]) != digest
    assert custody.body_sha256({"a": 1, "sig": "x"}) == hashlib.sha256(b'{"a":1}').hexdigest()


def test_claims():
    certs = {"deployment_certificates": [1]}
    assert "no certificate chain" in custody.claim({}, True, True, "r")
    assert "not evaluated" in custody.claim(certs, False, True, "r")
    assert "no verifiable signed manifest" in custody.claim(certs, True, False, "r")
    assert "fingerprint" in custody.claim(certs, True, True, None) and not custody.claim(certs, True, True, "r")


def verify(spark, leaves, seals, **kw):
    text = lambda rows: spark.createDataFrame([(json.dumps(x),) for x in rows], "value string")
    return evidence.verify_bundle(text(leaves), text(seals), **kw).first()


def test_a_bundle_with_handovers(spark):
    leaves, seals = bundle()
    leaves = [x | {"signer_key_id": NEW if i else "stranger"} for i, x in enumerate(leaves)]
    r = verify(spark, leaves, seals, keys=KEYS, rotations=[ROW], signed=lambda *_: True)
    assert r["ok"] and r["rotations_checked"] == 1 and r["unexplained_key_ids"] == ["stranger"]
    assert r["attestation"] == "SELF-ATTESTED" and r["attestation_reasons"] == ["no certificate chain in bundle"]
    r = verify(spark, leaves, seals, rotations=[{"record": None}])
    assert not r["ok"] and r["error"] == "key handover carries no record" and r["attestation"] is None


def test_whatever_raises_fails_the_bundle(spark):
    leaves, seals = bundle()
    r = verify(spark, leaves, seals, keys=[{"key_id": ["unhashable"]}])
    assert not r["ok"] and r["error"] == "malformed bundle (TypeError)"
    r = verify(spark, leaves, [seals[0] | {"merkle_root": 7}])
    assert not r["ok"]


def test_agent_actions(spark):
    rows = [
        (1, "a", 1, "ls"), (2, "a", 2, "git reset --hard HEAD~1"), (3, "a", 3, "drop table users"), (4, "a", 4, "ls"), (5, "a", 20, "rm -rf /"),
        (6, "a", 21, "ls"), (7, None, 5, "drop table x"), (8, None, 6, "ls"), (9, "b", None, None), (10, "c", 22, None), (11, "d", 22, "ls"),
    ]
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    acts = at(spark.createDataFrame(rows, "id long, run string, s long, payload string"))
    clears = at(spark.createDataFrame([("a", 10), ("z", 1)], "run string, s long"))
    state = lambda **kw: {r["id"]: r["state"] for r in agent.screen_actions(acts, clears, **kw).collect()}
    got = state()
    assert got[2] in ("flagged", "tripped") and [got[i] for i in (1, 4, 5, 6, 7, 8, 9, 10, 11)] == ["passed", "refused", "tripped", "refused", "tripped", "passed", "flagged", "tripped", "passed"]
    panic = state(threshold=3)
    assert panic[5] == "tripped" and panic[10] == panic[11] == panic[6] == "refused"
    assert agent.screen_actions(acts.limit(0)).count() == 0
    seen = []
    screened = agent.screen_actions(acts, clears)
    agent.tell(screened, lambda df, n: seen.extend(r["id"] for r in df.collect()))
    assert 5 in seen and 4 not in seen
    agent.tell(screened, lambda df, n: 1 / 0)
