"""Session summaries keep the types of their JSON values."""

import pytest

from actilens.operators import sessions

CASES = [
    ('{"x": "5"}', "old", 0.0, 0, None, None),
    ('{"x": true, "y": 2}', "old", 0.0, 3, "Unknown", {"x": 1, "y": 2}),
    ('{"a": 2.7, "b": -1.5}', "old", 0.0, 1, "Unknown", {"a": 2, "b": -1}),
    ('{"x": null, "y": 1}', "old", 0.0, 0, None, None),
    (
        '{"key_counts": {"a": "7", "b": "x", "c": 2.9, "d": -2.9, "e": true, "f": null}, "duration_seconds": "1.5", "total_keystrokes": " 12 "}',
        "new", 1.5, 12, "Unknown", {"a": 7, "b": 0, "c": 2, "d": -2, "e": 1, "f": 0},
    ),
    ('{"key_counts": {}, "total_keystrokes": "5.5", "duration_seconds": 3}', "new", 3.0, 0, None, {}),
    ('{"key_counts": [1], "total_keystrokes": -3.7, "active_window": ""}', "new", 0.0, -3, "Unknown", None),
    ('{"key_counts": {"a": 1}, "duration_seconds": null, "active_window": "mail"}', "new", 0.0, 0, None, {"a": 1}),
    ('{"key_counts": {"a": 1}, "active_window": "mail"}', "new", 0.0, 0, "mail", {"a": 1}),
    ("[1]", None, 0.0, 0, None, None),
    ("not json", None, 0.0, 0, None, None),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_typed_values(make_logs, case, spark):
    text, *want = CASES[case]
    logs = make_logs([{"activity_type": "KEYLOG", "activity_summary": text}])
    r = sessions.key_sessions(logs).select("shape", "duration", "keystrokes", "app", "key_counts").first()
    assert [r.shape, r.duration, r.keystrokes, r.app, r.key_counts] == want
