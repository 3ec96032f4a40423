"""Custody of an evidence bundle: what its manifest, key list and key handovers say of each other.

These parts are small JSON documents and stay on the driver. A handover is
checked by a table of conditions on facts about it. Signatures need a library
that is optional: a caller that has one passes ``signed``, a function of public
key (PEM), signed hash and signature; without it they are reported as skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from ..functions import fixed_values as V
from .ledger import canonical

Signed = Callable[[str, str, str], bool]


def body_sha256(document: dict) -> str:
    """Hash of a document without its signature."""
    return hashlib.sha256(canonical({k: v for k, v in document.items() if k not in V.UNSIGNED_FIELDS})).hexdigest()


def key_id(pem: str) -> str:
    """First 16 hex digits of the hash of a public key's text."""
    return hashlib.sha256(pem.encode()).hexdigest()[:16]


def issued_format(value, ending: str) -> bool:
    """Whether a format is an issuer's name with the given ending."""
    return isinstance(value, str) and value.endswith(ending) and value.removesuffix(ending).isalnum()


def rotations_digest(rotations: Iterable) -> str:
    """Commitment to the handovers' ids, whole records and signatures, in any order."""
    rows = []
    for r in rotations:
        row = r if isinstance(r, dict) else {}
        record = row.get("record")
        said = [str(row.get(k) or "") for k in ("retiring_key_id", "successor_key_id", "retiring_sig", "successor_sig")]
        rows.append([*said[:2], hashlib.sha256(canonical(record)).hexdigest() if isinstance(record, dict) else "", *said[2:]])
    return hashlib.sha256(canonical(sorted(rows))).hexdigest()


@dataclass
class Handover:
    """Facts about one row of the handovers."""

    row: object

    @cached_property
    def record(self) -> dict:
        found = self.row.get("record") if isinstance(self.row, dict) else None
        return found if isinstance(found, dict) else {}

    @cached_property
    def extra_row(self) -> str:
        return ", ".join(sorted(map(str, set(self.row) - set(V.HANDOVER_ROW_FIELDS))))

    @cached_property
    def extra(self) -> str:
        return ", ".join(sorted(map(str, set(self.record) - set(V.HANDOVER_FIELDS))))

    @cached_property
    def ids(self) -> tuple:
        return tuple(self.record.get(f"{side}_key_id") for side in ("retiring", "successor"))

    @cached_property
    def pems(self) -> tuple:
        return tuple(self.record.get(f"{side}_public_key_pem") for side in ("retiring", "successor"))

    def named(self) -> bool:
        return all(isinstance(x, str) and x for x in self.ids)

    def without_key(self, side: int) -> bool:
        return not (isinstance(self.pems[side], str) and self.pems[side])

    def other_key(self, side: int) -> bool:
        return key_id(self.pems[side]) != self.ids[side]


#: Message and condition, in the order in which they decide.
HANDOVER_CHECKS: list[tuple[str, Callable[[Handover], bool]]] = [
    ("row", lambda h: not isinstance(h.row, dict)),
    ("row_fields", lambda h: bool(h.extra_row)),
    ("record", lambda h: not isinstance(h.row.get("record"), dict)),
    ("format", lambda h: not issued_format(h.record.get("format"), V.HANDOVER_FORMAT)),
    ("fields", lambda h: bool(h.extra)),
    ("unnamed", lambda h: not h.named()),
    ("own_successor", lambda h: h.ids[0] == h.ids[1]),
    ("no_retiring_key", lambda h: h.without_key(0)),
    ("other_retiring_key", lambda h: h.other_key(0)),
    ("no_successor_key", lambda h: h.without_key(1)),
    ("other_successor_key", lambda h: h.other_key(1)),
]


def handover_problem(row) -> str | None:
    """Why a handover is no sound record of itself; None if it is one as far as can be seen without signatures."""
    h = Handover(row)
    return next((V.HANDOVER_MESSAGES[name].format(h=h, format=h.record.get("format")) for name, holds in HANDOVER_CHECKS if holds(h)), None)


@dataclass
class Custody:
    """Outcome: the failure if any, warnings, handovers whose signatures held, and the keys that some handover names."""

    error: str | None = None
    warnings: list[str] = field(default_factory=list)
    rotations_checked: int = 0
    explained: set[str] = field(default_factory=set)


def _same_key(a: str, b) -> bool:
    return isinstance(b, str) and "".join(a.split()) == "".join(b.split())


def check_custody(manifest: dict, trusted: bool, keys: list, rotations: list, signed: Signed | None = None) -> Custody:
    """The key list and the handovers against a trusted manifest and against themselves."""
    out = Custody()
    pems = {k.get("key_id"): k.get("public_key_pem") for k in keys if isinstance(k, dict)}
    listed, committed = manifest.get("key_ids"), manifest.get("rotations_digest")
    gone = sorted(str(k) for k in listed if k not in pems) if trusted and isinstance(listed, list) else []
    if gone:
        out.error = V.CUSTODY_MESSAGES["keys_gone"].format(", ".join(gone))
    elif trusted and committed is not None and rotations_digest(rotations) != committed:
        out.error = V.CUSTODY_MESSAGES["rotations"]
    if out.error:
        return out
    if rotations and not trusted:
        out.warnings.append(V.CUSTODY_MESSAGES["untrusted"])
    for row in rotations:
        out.error = handover_problem(row) or _signatures(Handover(row), pems, out, signed)
        if out.error:
            break
    return out


def _signatures(h: Handover, pems: dict, out: Custody, signed: Signed | None) -> str | None:
    old, new = h.ids
    if signed is None:
        out.explained |= {old, new}
        out.warnings.append(V.CUSTODY_MESSAGES["unverified"].format(old, new))
        return None
    digest = hashlib.sha256(canonical(h.record)).hexdigest()
    for side, pem in zip(("retiring", "successor"), h.pems):
        if not signed(pem, digest, str(h.row.get(f"{side}_sig") or "")):
            return V.CUSTODY_MESSAGES["signature"].format(side)
    out.rotations_checked += 1
    differing = sorted(k for k, pem in zip(h.ids, h.pems) if k in pems and not _same_key(pem, pems[k]))
    absent = sorted(k for k in h.ids if k not in pems)
    if differing:
        return V.CUSTODY_MESSAGES["differs"].format(", ".join(differing))
    if absent:
        out.warnings.append(V.CUSTODY_MESSAGES["absent"].format(old, new, ", ".join(absent)))
    out.explained |= {k for k in h.ids if k in pems}
    return None


def claim(certificates: dict, signatures_checked: bool, trusted: bool, root: str | None) -> str:
    """Why an intact bundle is self-attested and no more, as far as the bundle's form says; empty if only its certificates can tell."""
    chain = certificates.get("deployment_certificates") or certificates.get("issuing_certificates")
    reasons = {"no_chain": not chain, "not_evaluated": not signatures_checked, "no_manifest": not trusted, "no_root": not root}
    return next((V.ATTESTATION_REASONS[name] for name, holds in reasons.items() if holds), "")
