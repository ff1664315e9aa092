"""Planned writes: hash-preconditioned creates and updates, checked on the whole collection before and after."""

from __future__ import annotations

import difflib
import fcntl
import json
import os
import re
import tempfile
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import yaml

from .. import __version__
from ..errors import MergeError, MutationError
from ..functions.canonical import canonical, digest, text_hash
from ..manifest import Manifest
from ..scan import ScanResult, check_note_path, scan, vault_digest
from .merge import verify_plan
from .parse import parse_bytes, split_frontmatter

REQUEST_SCHEMA = "notegraph.node-mutation-request/v1"
PLAN_SCHEMA = "notegraph.node-mutation-plan/v1"
RECEIPT_SCHEMA = "notegraph.node-mutation-receipt/v1"
MERGE_VALIDATION_SCHEMA = "notegraph.merge-validation/v1"
MERGE_RECEIPT_SCHEMA = "notegraph.merge-receipt/v1"


# -- rendering -----------------------------------------------------------------------------------


_PLAIN = re.compile(r"[A-Za-z][A-Za-z0-9_./-]*(?: [A-Za-z0-9_./-]+)*")
_IN_QUOTES = re.compile(r"\[[A-Za-z0-9_./()\[\]|# -]*[A-Za-z0-9_./()\[\]|#-]|\d{4}-\d\d-\d\d", re.A)
_NOT_PLAIN = {"y", "n", "yes", "no", "on", "off", "true", "false", "null"}


def _scalar(value: Any) -> str | None:
    """The commonest values as the dumper writes them; null for any other."""
    if type(value) is int:
        return str(value)
    if type(value) is not str or len(value) > 1000:
        return None
    if _PLAIN.fullmatch(value):
        return value if value.lower() not in _NOT_PLAIN else None
    return f"'{value}'" if _IN_QUOTES.fullmatch(value) else None


def _dump(key: str, value: Any) -> str:
    if type(key) is str and len(key) < 100 and _PLAIN.fullmatch(key) and key.lower() not in _NOT_PLAIN:
        items = [_scalar(v) for v in value] if type(value) is list and len(value) <= 500 else [_scalar(value)]
        if None not in items:
            return f"{key}: [{', '.join(items)}]\n" if type(value) is list else f"{key}: {items[0]}\n"
    return yaml.safe_dump({key: value}, allow_unicode=True, sort_keys=False, default_flow_style=None if isinstance(value, (list, dict)) else False, width=1_000_000)


def render(original: bytes | None, properties: dict[str, Any], body: str, legacy_colons: bool = False) -> bytes:
    """The note with these properties and body. Lines of properties that don't change stay as they are, with
    comments and quotes; changed ones are written anew in place, new ones at the end."""
    if original is None:
        head = "".join(_dump(k, v) for k, v in properties.items())
        return (f"---\n{head}---\n{body}" if properties else body).encode()
    text = original.decode()
    old, old_body = parse_bytes(original, legacy_colons)
    if canonical(old) == canonical(properties):
        return original if old_body == body else (text[: len(text) - len(old_body)] + body).encode()
    head, _ = split_frontmatter(text)
    spans: list[tuple[str | None, list[str]]] = []
    for line in (head or "").splitlines(keepends=True):
        name = line.split(":", 1)[0].strip("'\"") if line[:1] not in (" ", "\t", "#", "-", "\n", "\r", "") and ":" in line else None
        if name is not None or not spans:
            spans.append((name, [line]))
        else:
            spans[-1][1].append(line)
    out, done = [], set()
    for name, lines in spans:
        if name is None or name in done:
            out += lines
        elif name in properties:
            done.add(name)
            same = name in old and canonical(old[name]) == canonical(properties[name])
            tail = [x for x in lines[1:] if not x.strip() or x.lstrip().startswith("#")] if not same else []
            out += lines if same else [_dump(name, properties[name]), *tail]
    out += [_dump(k, v) for k, v in properties.items() if k not in done]
    if head is None:
        result = f"---\n{''.join(out)}---\n{body}"
    else:
        opening = text[: text.index("\n") + 1]
        closing = text[len(opening) + len(head) : len(text) - len(old_body)]
        joined = "".join(out)
        result = opening + joined + ("" if joined.endswith("\n") or not joined else "\n") + closing + body
    got, got_body = parse_bytes(result.encode(), legacy_colons)
    if canonical(got) != canonical(properties) or got_body != body:
        raise MutationError("the note's frontmatter can't be edited in place")
    return result.encode()


def unified_diff(path: str, before: bytes | None, after: bytes) -> str:
    a = before.decode().splitlines(keepends=True) if before is not None else []
    b = after.decode().splitlines(keepends=True)
    out = []
    for line in difflib.unified_diff(a, b, "/dev/null" if before is None else f"a/{path}", f"b/{path}"):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


# -- plans ---------------------------------------------------------------------------------------


def check_request(request: Any) -> dict[str, Any]:
    ok = isinstance(request, dict) and request.get("schemaVersion") == REQUEST_SCHEMA and request.get("operation") in ("create", "update")
    ok = ok and all(isinstance(request.get(k), str) and request[k] for k in ("path", "kind"))
    if not ok:
        raise MutationError("not a node mutation request")
    if request["operation"] == "create":
        document = request.get("document")
        good = isinstance(document, dict) and isinstance(document.get("properties"), dict) and isinstance(document.get("body"), str) and set(request) <= {"schemaVersion", "operation", "path", "kind", "document"}
    else:
        changes = request.get("changes")
        good = isinstance(changes, dict) and isinstance(request.get("expectedSourceHash"), str) and set(changes) <= {"setProperties", "removeProperties", "body"} and bool(changes) and set(request) <= {"schemaVersion", "operation", "path", "kind", "expectedSourceHash", "changes"}
        good = good and isinstance(changes.get("setProperties", {}), dict) and isinstance(changes.get("removeProperties", []), list) and isinstance(changes.get("body", ""), str)
        if good and set(changes.get("setProperties", {})) & set(changes.get("removeProperties", [])):
            raise MutationError("a property can't be set and removed at once")
    if not good:
        raise MutationError(f"malformed {request['operation']} request")
    return request


def _counts(result: ScanResult) -> dict[str, Any]:
    return result.summary().first().asDict()


def _issues(result: ScanResult) -> list[dict[str, Any]]:
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in result.ordered_issues().collect()]


def _target(manifest: Manifest, path: str, exists: bool) -> Path:
    check_note_path(manifest, path)
    at = manifest.root / path
    if at.exists() != exists:
        raise MutationError(f"{path} {'does not exist' if exists else 'exists already'}")
    if not at.parent.is_dir():
        raise MutationError(f"the folder of {path} does not exist")
    return at


def plan_node_mutation(spark, manifest: Manifest, request: dict[str, Any]) -> dict[str, Any]:
    """What a request would do: the candidate, the diff, and the validity of the collection with it."""
    check_request(request)
    path, create = request["path"], request["operation"] == "create"
    at = _target(manifest, path, not create)
    before = None if create else at.read_bytes()
    if create:
        properties, body = request["document"]["properties"], request["document"]["body"]
    else:
        if text_hash(before) != request["expectedSourceHash"]:
            raise MutationError(f"{path} changed since it was read")
        properties, body = parse_bytes(before, manifest.legacy_colons)
        changes = request["changes"]
        missing = [k for k in changes.get("removeProperties", []) if k not in properties]
        if missing:
            raise MutationError(f"property {missing[0]!r} isn't there to be removed")
        properties = {k: v for k, v in properties.items() if k not in changes.get("removeProperties", [])} | changes.get("setProperties", {})
        body = changes.get("body", body)
    after = render(before, properties, body, manifest.legacy_colons)
    if after == before:
        raise MutationError("the request changes nothing")
    result = scan(spark, manifest, **({"creates": {path: after}} if create else {"updates": {path: after}}))
    row = result.nodes.where(f"path = {_quoted(path)}").select("kind").take(1)
    issues = _issues(result)
    if row and row[0].kind != request["kind"]:
        issues.append({"level": "error", "code": "node.kind-mismatch", "message": f"node is of kind '{row[0].kind}', not '{request['kind']}'", "path": path})
    if (at.read_bytes() if at.exists() else None) != before:
        raise MutationError(f"{path} changed while the plan was made")
    core = {
        "schemaVersion": PLAN_SCHEMA, "vaultId": manifest.vault_id, "engineVersion": __version__, "manifestDigest": manifest.digest, "request": request,
        "precondition": {"exists": not create, **({} if create else {"sourceHash": text_hash(before)})},
        "candidate": {"content": after.decode(), "sourceHash": text_hash(after)}, "diff": unified_diff(path, before, after),
        "valid": not any(i["level"] == "error" for i in issues), "summary": _counts(result), "issues": issues, "vaultDigest": vault_digest(result),
    }
    return core | {"planId": digest(core)}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def check_plan(plan: dict[str, Any]) -> dict[str, Any]:
    core = {k: v for k, v in plan.items() if k != "planId"}
    if plan.get("schemaVersion") != PLAN_SCHEMA or plan.get("planId") != digest(core):
        raise MutationError("the plan was changed or isn't a mutation plan")
    if text_hash(plan["candidate"]["content"].encode()) != plan["candidate"]["sourceHash"]:
        raise MutationError("the candidate doesn't fit its hash")
    return plan


def recheck(spark, manifest: Manifest, plan: dict[str, Any]) -> dict[str, Any]:
    """The plan, if it comes out the same on the collection as it is now."""
    check_plan(plan)
    if plan["manifestDigest"] != manifest.digest or plan["engineVersion"] != __version__ or plan["vaultId"] != manifest.vault_id:
        raise MutationError("the plan was made for another collection, manifest or engine")
    if plan_node_mutation(spark, manifest, plan["request"])["planId"] != plan["planId"]:
        raise MutationError("the collection changed since the plan was made")
    return plan


# -- writing -------------------------------------------------------------------------------------


@contextmanager
def vault_lock(manifest: Manifest):
    with open(manifest.root / manifest.folder / "manifest.json", "rb") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            raise MutationError("another write holds the collection") from None
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def sync_folder(at: Path) -> None:
    """The folder's entries on disk, so that a write outlives a crash."""
    f = os.open(at, os.O_RDONLY)
    try:
        os.fsync(f)
    finally:
        os.close(f)


def write_note(at: Path, data: bytes, create: bool) -> None:
    """Staged beside, synced, then linked (which never overwrites) or renamed into place."""
    fd, name = tempfile.mkstemp(dir=at.parent, prefix=".notegraph-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if create:
            os.chmod(name, 0o644)
            os.link(name, at)
        else:
            os.chmod(name, os.stat(at).st_mode & 0o777)
            os.replace(name, at)
        sync_folder(at.parent)
    except FileExistsError:
        raise MutationError(f"{at.name} was created by someone else") from None
    finally:
        if os.path.exists(name):
            os.unlink(name)


def _apply(spark, manifest: Manifest, path: str, after: bytes, expected: str | None, expected_digest: str, schema: str, plan_id: str, write=write_note, validation: str | None = None) -> dict[str, Any]:
    """Writes, scans again, and takes the write back if the collection isn't as foreseen; a receipt tells which."""
    at = manifest.root / path
    before = at.read_bytes() if at.exists() else None
    if (text_hash(before) if before is not None else None) != expected:
        raise MutationError(f"{path} changed since the plan was made")
    state, error, seen = "applied", None, None
    try:
        write(at, after, before is None)
    except OSError as e:
        state, error = "failed", str(e)
    if state == "applied":
        try:
            seen = vault_digest(scan(spark, manifest))
            problem = None if seen == expected_digest else "the collection isn't as the plan foresaw"
        except Exception as e:
            problem = str(e)
        if problem:
            state, error = "failed", problem
            if at.exists() and at.read_bytes() == after:  # nobody wrote since
                if before is None:
                    at.unlink()
                    sync_folder(at.parent)
                else:
                    write_note(at, before, False)
                state = "rolled-back"
    core = {"schemaVersion": schema, "vaultId": manifest.vault_id, "manifestDigest": manifest.digest, "engineVersion": __version__, "planId": plan_id, **({"validationDigest": validation} if validation else {}), "expectedVaultDigest": expected_digest, "path": path, "state": state, "before": text_hash(before) if before is not None else None, "after": text_hash(after), "vaultDigest": seen, "error": error}
    return core | {"operationId": digest(core)}


def apply_node_mutation_plan(spark, manifest: Manifest, plan: dict[str, Any], write=write_note) -> dict[str, Any]:
    if "node-mutation-apply" not in manifest.capabilities:
        raise MutationError("the manifest doesn't allow mutations to be applied")
    check_plan(plan)
    if not plan["valid"]:
        raise MutationError("the plan isn't valid")
    with vault_lock(manifest):
        recheck(spark, manifest, plan)
        return _apply(spark, manifest, plan["request"]["path"], plan["candidate"]["content"].encode(), plan["precondition"].get("sourceHash"), plan["vaultDigest"], RECEIPT_SCHEMA, plan["planId"], write)


def _merge_candidate(manifest: Manifest, plan: dict[str, Any]) -> bytes:
    verify_plan(plan)
    if plan["state"] != "clean":
        raise MergeError("the plan has conflicts")
    if plan["manifestDigest"] != manifest.digest or plan["engineVersion"] != __version__ or plan["vaultId"] != manifest.vault_id:
        raise MergeError("the plan was made for another collection, manifest or engine")
    at = _target(manifest, plan["path"], True)
    current = at.read_bytes()
    if text_hash(current) != plan["inputs"]["ours"]["sourceHash"]:
        raise MergeError(f"{plan['path']} isn't the plan's own side any more")
    return render(current, plan["candidate"]["properties"], plan["candidate"]["body"], manifest.legacy_colons)


def validate_merge_plan(spark, manifest: Manifest, plan: dict[str, Any]) -> dict[str, Any]:
    """Whether the collection is valid with a clean plan's candidate in place."""
    after = _merge_candidate(manifest, plan)
    result = scan(spark, manifest, updates={plan["path"]: after})
    issues = _issues(result)
    _merge_candidate(manifest, plan)
    core = {"schemaVersion": MERGE_VALIDATION_SCHEMA, "vaultId": manifest.vault_id, "planId": plan["planId"], "path": plan["path"], "valid": not any(i["level"] == "error" for i in issues), "candidateSourceHash": text_hash(after), "vaultDigest": vault_digest(result), "summary": _counts(result), "issues": issues}
    return core


def apply_merge_plan(spark, manifest: Manifest, plan: dict[str, Any], write=write_note) -> dict[str, Any]:
    """For callers of the library; the command line doesn't offer it."""
    if "semantic-merge-apply" not in manifest.capabilities:
        raise MergeError("the manifest doesn't allow merges to be applied")
    with vault_lock(manifest):
        checked = validate_merge_plan(spark, manifest, plan)
        if not checked["valid"]:
            raise MergeError("the collection would not be valid")
        return _apply(spark, manifest, plan["path"], _merge_candidate(manifest, plan), plan["inputs"]["ours"]["sourceHash"], checked["vaultDigest"], MERGE_RECEIPT_SCHEMA, plan["planId"], write, digest(checked))


def load_json(path: str | Path) -> Any:
    try:
        return json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise MutationError(f"can't read {path}: {e}") from None
