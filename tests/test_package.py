"""The library doesn't use the training-data subpackage."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_llm():
    for path in (ROOT / "ledgerloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"ledgerloom\.llm|from \.*llm", path.read_text())
