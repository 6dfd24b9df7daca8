from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from jobtrail.functions import scalars as P

X = F.col("x")


def one(evaluate, value, column, kind="string"):
    return evaluate(f"x {kind}", [(value,)], column)[0][0]


@pytest.fixture
def table(evaluate):
    """Check a one-argument function over (input, expected) pairs in one job."""

    def run(fn, cases, kind="string"):
        got = evaluate(f"x {kind}", [(c[0],) for c in cases], X, fn(X))
        assert [(a, b) for a, b in got] == [tuple(c) for c in cases]

    return run


def test_priority(table):
    table(P.priority_bucket, [(5, "high"), (3, "high"), (2, "medium"), (1, "low"), (0, "low"), (-1, "low")], "int")
    table(P.priority_rank, [("high", 3), ("medium", 2), ("low", 1), ("other", 1)])


def test_status(table):
    table(P.status_from_topic, [("a.b.Running", "Running"), ("Running", ""), ("a.b.", ""), ("", "")])
    table(P.is_valid_status, [("Queued", True), ("queued", False), ("", False), ("Done", False), (None, False)])
    table(P.is_terminal, [("Queued", False), ("Running", False), ("Succeeded", True), ("Failed", True), ("Stopped", True)])


def test_first_reason(table):
    cases = [([], ""), (["ImagePullBackOff"], "ImagePullBackOff"), (["", "boom"], "boom"), (["", ""], ""), (None, "")]
    table(P.first_reason, cases, "array<string>")


def test_memory_limits(table):
    good = [("3G", 3 << 30), ("7g", 7 << 30), ("40G", 40 << 30), ("5M", 5 << 20), ("6m", 6 << 20), ("768M", 768 << 20), ("+3G", 3 << 30), ("0M", 0)]
    bad = [("4T", "unit"), ("8K", "unit"), ("9B", "unit"), ("x1M", "value"), ("", "format"), ("m", "format"), ("-2M", "negative"),
           ("777", "unit"), ("6 G", "value"), ("8589934592G", "overflow"), ("99999999999999999999M", "value"), ("3G\n", "value")]
    table(P.memory_limit_bytes, good + [(t, None) for t, _ in bad])
    table(P.memory_limit_error, bad + [(t, None) for t, _ in good])


def test_find_limit(evaluate):
    rows = [(0, 0), (0, 4), (6, 0), (4, 6), (6, 4), (8, 8)]
    assert [r[0] for r in evaluate("a int, b int", rows, P.find_limit(F.col("a"), F.col("b")))] == [0, 4, 6, 4, 4, 8]
    floats = [(0.0, 0.0), (0.0, 0.25), (1.5, 0.0), (9.75, 0.5)]
    assert [r[0] for r in evaluate("a double, b double", floats, P.find_limit(F.col("a"), F.col("b"), 0.0))] == [0.0, 0.25, 1.5, 0.5]
    texts = [("", ""), ("", "oak"), ("elm", ""), ("fir", "ash")]
    assert [r[0] for r in evaluate("a string, b string", texts, P.find_limit(F.col("a"), F.col("b"), ""))] == ["", "oak", "elm", "ash"]


def test_find_memory_limit(evaluate):
    rows = [("", ""), ("3G", ""), ("", "9M"), ("3G", "9M"), ("700M", "3G"), ("lots", "9M"), ("3G", "lots"), ("lots", "more")]
    want = [0, 3 << 30, 9 << 20, 9 << 20, 700 << 20, 9 << 20, 3 << 30, 0]
    assert [r[0] for r in evaluate("a string, b string", rows, P.find_memory_limit(F.col("a"), F.col("b")))] == want


def test_network_modes(table):
    valid = ["", "none", "bridge", "host", "default", "lab-7", "ci.lan_2", "9lives"]
    invalid = [" ", "la b", "lan 2", "-lan", ".lan", "lan/2", "la\tn", "lan\n"]
    table(lambda c: P.network_mode_error(c).isNull(), [(v, True) for v in valid] + [(v, False) for v in invalid])


def test_callback_urls(table):
    absolute, scheme, host = "callback URL must be absolute", "callback URL scheme must be http or https", "callback URL must include a host"
    broken = "callback URL is not parseable"
    table(
        P.callback_url_error,
        [
            ("http://collector:9100/in", None),
            ("https://logs.example/in/put", None),
            ("HTTPS://Logs.Example:9443/p", None),
            ("http://[::1]:80/x", None),
            ("http://:80/", None),
            ("", absolute),
            ("/in/put", absolute),
            ("logs.example/in", absolute),
            ("gopher://logs.example/in", scheme),
            ("file:///srv/in", scheme),
            ("mailto:ops", scheme),
            ("http:///in", host),
            ("http://u@/", host),
            ("http:opaque", host),
            ("http://a b/", broken),
            ("http://h:port/", broken),
            ("http://h/%zz", broken),
            ("://h", broken),
            ("http://h/\x01", broken),
            (":seg/../x y", broken),
        ],
    )


def test_sanitize_callback_url(table):
    table(
        P.sanitize_callback_url,
        [
            ("https://bob:0pen@logs.example/in?k=1#top", "https://logs.example/in"),
            ("HTTPS://h/x", "https://h/x"),
            ("https://h/a@b", "https://h/a@b"),
            ("http://h/%zz?token=1", "http://h/%zz?token=1"),
            ("/x?y", "/x"),
            ("", ""),
        ],
    )


def test_environment(evaluate):
    meta = {"A": "job", "B": "job", "UUID": "fake"}
    step = {"B": "step", "JOB_NAME": "fake"}
    env = P.effective_env(F.col("m"), F.col("s"), P.reserved_env(F.lit("id-1"), F.lit("name")))
    (got,) = evaluate("m map<string,string>, s map<string,string>", [(meta, step)], env, P.env_rows(env))
    assert got[0] == {"A": "job", "B": "step", "UUID": "id-1", "JOB_NAME": "name"}
    assert [r.name for r in got[1]] == ["A", "B", "JOB_NAME", "UUID"]
    assert evaluate("m map<string,string>, s map<string,string>", [(None, None)], env)[0][0] == {"UUID": "id-1", "JOB_NAME": "name"}


def test_tolerated_step_passes_its_script(evaluate):
    schema = "script string, continue_on_error boolean"
    step = {c: F.col(c) for c in ("script", "continue_on_error")}
    env = P.reserved_env(F.lit("i"), F.lit("n"), step, "STEP_SCRIPT")
    got = evaluate(schema, [("exit 1", True), ("exit 1", False), (" \n", True)], F.map_contains_key(env, F.lit("STEP_SCRIPT")))
    assert [r[0] for r in got] == [True, False, False]


def test_priority_metadata(evaluate):
    rows = [(None, 7), ({"priority": "9", "x": "y"}, 2)]
    got = [r[0] for r in evaluate("m map<string,string>, p int", rows, P.priority_metadata(F.col("m"), F.col("p")))]
    assert got == [{"priority": "3", "priorityName": "high"}, {"x": "y", "priority": "2", "priorityName": "medium"}]


def test_label_priority(table):
    cases = [({"priority": " 5 "}, 5), ({"priority": "0"}, 1), ({"priority": "x"}, 1), ({"other": "3"}, 1), (None, 1), ({"priority": "-2"}, 1)]
    table(P.label_priority, cases, "map<string,string>")


def test_requests_follow_limits_only_when_none_is_set(evaluate):
    cols = [F.col(c) for c in ("cl", "ml", "cr", "mr")]
    req = P.effective_requests(*cols)
    rows = [("1", "2G", None, None), ("1", "2G", "500m", None), (None, None, None, "1G")]
    got = evaluate("cl string, ml string, cr string, mr string", rows, req["cpu_request"], req["memory_request"])
    assert got == [("1", "2G"), ("500m", None), (None, "1G")]


def test_ids(table):
    low = "63e4a1b0-7c2d-4f6e-8a95-0d1b2c3e4f56"
    table(
        P.canonical_job_id,
        [(low, low), (low.upper(), low), ("{" + low + "}", low), ("URN:UUID:" + low, low), (low.replace("-", ""), low), ("not-a-uuid", None),
         (low[:-1], None), (low + "\n", None), (low.replace("6", "g"), None), ("", None), (None, None)],
    )
    table(P.truncate_id, [("abcdefghij", "abcdefgh"), ("ab", "ab")])


def test_container_state(evaluate):
    rows = [(True, True, 0), (False, True, None), (False, False, 0), (False, False, 3), (False, False, None)]
    state = P.container_state(F.col("w"), F.col("r"), F.col("e"))
    assert [r[0] for r in evaluate("w boolean, r boolean, e int", rows, state)] == ["Pending", "Running", "Succeeded", "Failed", "Unknown"]


def test_clamp_timeout(table):
    table(P.clamp_timeout, [(0, None), (-4, None), (600, 600), (9223372037, 9223372036)], "long")


def test_durations(table, evaluate):
    table(
        P.format_duration,
        [(None, "-"), (0, "0ms"), (999, "999ms"), (1000, "1.0s"), (1500, "1.5s"), (59949, "59.9s"), (60000, "1m 0s"), (119600, "2m 0s"), (125000, "2m 5s")],
        "long",
    )
    t = lambda ms: datetime.fromtimestamp(1_700_000_000 + ms / 1000, timezone.utc)
    rows = [(t(0), t(2500)), (t(2500), t(0)), (None, t(0)), (t(0), None)]
    got = evaluate("a timestamp, b timestamp", rows, P.duration_ms(F.col("a"), F.col("b"), F.lit(t(9000))))
    assert [r[0] for r in got] == [2500, -2500, None, 9000]


def test_relative_time(evaluate):
    as_of = datetime(2024, 1, 31, tzinfo=timezone.utc)
    back = lambda s: datetime.fromtimestamp(as_of.timestamp() - s, timezone.utc)
    cases = [(back(5), "5s ago"), (back(59.4), "59s ago"), (back(59.6), "1m ago"), (back(3599), "59m ago"), (back(7200), "2h ago"), (back(3 * 86400), "3d ago"), (back(-3), "just now"), (None, "-")]
    got = evaluate("x timestamp", [(c,) for c, _ in cases], P.relative_time(X, F.lit(as_of)))
    assert [r[0] for r in got] == [w for _, w in cases]
