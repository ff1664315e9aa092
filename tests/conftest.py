import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from notegraph.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=2, memory="3g")
    # tiny inputs: compiling code would take most of the time
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session


def base_manifest(**extra):
    return {
        "$schema": "local", "apiVersion": "notegraph/v1", "vaultId": "test-vault", "defaultKind": "document",
        "nodeKinds": {"document": {"selectors": [{"path": "notes/**"}], "fields": {"tags": {"type": "list"}}}},
        "relations": {"related": {"field": "related", "cardinality": "0..*", "targetKinds": ["document"]}},
    } | extra


@pytest.fixture
def make_vault(tmp_path, monkeypatch):
    """A folder of notes with a manifest; index state goes elsewhere."""
    monkeypatch.setenv("NOTEGRAPH_STATE_DIR", str(tmp_path / "state"))

    def make(notes, **manifest):
        root = tmp_path / "vault"
        (root / ".notegraph").mkdir(parents=True)
        (root / ".notegraph" / "manifest.json").write_text(json.dumps(base_manifest(**manifest)))
        for path, text in notes.items():
            at = root / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(text if isinstance(text, bytes) else text.encode())
        return root

    return make
