"""A key's rows go through the processor of updates as rows; a frame for each key took most of the time."""

import datetime
from types import SimpleNamespace

from pyspark.sql import Row

from corvia.streaming.updates import Continued


def test_rows_in_and_rows_out():
    held = []
    state = SimpleNamespace(get=lambda: tuple(held[-1]) if held else None, update=held.append)
    processor = Continued(str.upper)
    processor.init(SimpleNamespace(getValueState=lambda name, schema: state))
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    row = Row("document_id", "content_hash", "fingerprint", "text", "updated_at")
    known = Row("content_hash", "fingerprint", "revision_number", "missing_count", "seen_at")
    for number in (4, 7, 5):  # the last revision holds
        processor.handleInitialState(("a",), known(f"h{number}", "f", number, 0, at), None)
    later = at + datetime.timedelta(hours=1)
    found = list(processor.handleInputRows(("a",), iter([row("a", "h9", "f", "x", later), row("a", "h7", "f", "w", at)]), None))
    assert [(r.document_id, r.action, r.revision_number, r.result, r["at"]) for r in found] == [("a", "unchanged", 7, None, at), ("a", "updated", 8, "X", later)]
    assert held[-1][:4] == ("h9", "f", 8, 0)
