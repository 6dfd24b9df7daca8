"""Column expressions on scalars: priorities, statuses, limits, URLs, times. Built-ins only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtrail import schemas as S

def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


# --- priority and status -------------------------------------------------------------------


def priority_bucket(priority: Column) -> Column:
    return F.when(priority >= 3, "high").when(priority <= 1, "low").otherwise("medium")


def priority_rank(name: Column) -> Column:
    return F.when(name == "high", 3).when(name == "medium", 2).otherwise(1)


def status_from_topic(topic: Column) -> Column:
    return F.regexp_extract(topic, r"\.([^.]+)\z", 1)


def is_valid_status(status: Column) -> Column:
    return F.coalesce(status.isin(S.STATUSES), F.lit(False))


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(S.TERMINAL), F.lit(False))


def first_reason(reasons: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(reasons, lambda r: r != ""), F.lit(1)), F.lit(""))


# --- resource limits -----------------------------------------------------------------------


def _memory_parts(limit: Column):
    number = F.substring(limit, F.lit(1), F.length(limit) - 1)
    # A signed base-10 integer; a cast alone would also take blanks and decimals.
    value = F.when(number.rlike(r"^[+-]?[0-9]+\z"), number.try_cast("bigint"))
    unit = F.upper(F.right(limit, F.lit(1)))
    factor = F.when(unit == "G", F.lit(1 << 30)).when(unit == "M", F.lit(1 << 20))
    return value, factor


def memory_limit_error(limit: Column) -> Column:
    """NULL, or the first of: format, value, negative, unit, overflow."""
    value, factor = _memory_parts(limit)
    return (
        F.when(F.octet_length(limit) < 2, "format")
        .when(value.isNull(), "value")
        .when(value < 0, "negative")
        .when(factor.isNull(), "unit")
        .when(F.try_multiply(value, factor).isNull(), "overflow")
    )


def memory_limit_bytes(limit: Column) -> Column:
    value, factor = _memory_parts(limit)
    return F.when(value >= 0, F.try_multiply(value, factor))


def find_limit(x: Column, y: Column, zero=0) -> Column:
    """The smaller of two limits, where ``zero`` means no limit."""
    return F.coalesce(F.least(F.nullif(x, F.lit(zero)), F.nullif(y, F.lit(zero))), F.lit(zero))


def find_memory_limit(x: Column, y: Column) -> Column:
    """Effective limit in bytes; an empty or unreadable limit is no limit."""
    as_bytes = [F.coalesce(memory_limit_bytes(c), F.lit(0).cast("bigint")) for c in (x, y)]
    return find_limit(*as_bytes).cast("bigint")


# Network modes that need no name check.
_NETWORK_MODES = ["", "none", "bridge", "host", "default"]
_NETWORK_NAME = r"^[a-zA-Z0-9][a-zA-Z0-9_.-]*\z"
NETWORK_ERROR = "invalid network mode: must be none, bridge, host, default, or a valid network name"


def network_mode_error(network: Column) -> Column:
    ok = network.isNull() | network.isin(_NETWORK_MODES) | network.rlike(_NETWORK_NAME)
    return F.when(~ok, F.lit(NETWORK_ERROR))


# --- callback URLs -------------------------------------------------------------------------

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_BAD_ESCAPE = r"%(?![0-9a-fA-F]{2})"


def _url_parts(url: Column) -> Column:
    """struct(base, fragment, scheme, rest, path, authority, host); base is the text before the fragment."""
    base = F.substring_index(url, "#", 1)
    fragment = F.regexp_extract(url, r"(?s)^[^#]*#(.*)\z", 1)

    def after_scheme(b: Column) -> Column:
        scheme = F.lower(F.regexp_extract(b, _SCHEME, 1))
        return let(F.struct(b.alias("base"), scheme.alias("scheme")), with_rest)

    def with_rest(x: Column) -> Column:
        rest = F.substring(x["base"], F.when(x["scheme"] != "", F.length(x["scheme"]) + 2).otherwise(1), F.length(x["base"]))
        return let(F.struct(x["base"].alias("base"), x["scheme"].alias("scheme"), rest.alias("rest")), with_host)

    def with_host(x: Column) -> Column:
        path = F.substring_index(x["rest"], "?", 1)
        authority = F.regexp_extract(path, r"(?s)^//([^/]*)", 1)
        fields = {"base": x["base"], "fragment": fragment, "scheme": x["scheme"], "rest": x["rest"], "path": path}
        fields |= {"authority": authority, "host": F.substring_index(authority, "@", -1)}
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    return let(base, after_scheme)


def _unparseable(u: Column) -> Column:
    userinfo = F.regexp_extract(u["authority"], r"(?s)^(.*)@", 1)
    hostname = F.regexp_replace(u["host"], r"\A\[[^\]]*\]", "")
    return (
        u["base"].rlike(r"[\x00-\x1f\x7f]")
        | u["base"].startswith(":")
        # A first path segment that holds a colon is taken for a broken scheme.
        | ((u["scheme"] == "") & u["path"].rlike(r"^[^/]*:") & ~u["path"].startswith("/"))
        | u["path"].rlike(_BAD_ESCAPE)
        | u["fragment"].rlike(_BAD_ESCAPE)
        | userinfo.rlike(r"[^A-Za-z0-9\-._:~!$&'()*+,;=%@]")
        | hostname.rlike(r"[\x20{}|\\^`%/?#]")
        | (u["host"].startswith("[") & ~u["host"].contains("]"))
        | hostname.rlike(r":(?!\d*\z)")
    )


def callback_url_error(url: Column) -> Column:
    """NULL, or why ``url`` is no absolute http(s) URL with a host."""

    def error(u: Column) -> Column:
        return (
            F.when(_unparseable(u), "callback URL is not parseable")
            .when(u["scheme"] == "", "callback URL must be absolute")
            .when(~u["scheme"].isin("http", "https"), "callback URL scheme must be http or https")
            .when(u["host"] == "", "callback URL must include a host")
        )

    return let(_url_parts(url), error)


def callback_host(url: Column) -> Column:
    return _url_parts(url)["host"]


def sanitize_callback_url(url: Column) -> Column:
    """Drop userinfo, query and fragment; leave a broken URL as it is."""

    def clean(u: Column) -> Column:
        # A bare trailing "?" is not a query and stays.
        bare = F.when(u["rest"].rlike(r"(?s)^[^?]*\?\z"), F.lit("?")).otherwise(F.lit(""))
        scheme = F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise(F.lit(""))
        kept = F.regexp_replace(F.concat(u["path"], bare), r"(?s)^//[^/]*@", "//")
        return F.when(_unparseable(u), url).otherwise(F.concat(scheme, kept))

    return let(_url_parts(url), clean)


# --- environments and maps -----------------------------------------------------------------



def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def overlay(base: Column, over: Column) -> Column:
    """Union of two maps where ``over`` wins, whatever the session's duplicate-key policy is."""

    def merge(m: Column) -> Column:
        return F.map_concat(F.map_filter(m["base"], lambda k, _: ~F.map_contains_key(m["over"], k)), m["over"])

    return let(F.struct(F.coalesce(base, empty_map()).alias("base"), F.coalesce(over, empty_map()).alias("over")), merge)


def reserved_env(job_id: Column, job_name: Column, step=None, script_key: str | None = None) -> Column:
    """The keys that always win. ``script_key`` names the variable a tolerated step's script goes to."""
    env = F.create_map(F.lit("UUID"), job_id, F.lit("JOB_NAME"), job_name)
    if script_key is None:
        return env
    passed = step["script"].rlike(r"[^\s]") & F.coalesce(step["continue_on_error"], F.lit(False))
    return F.when(passed, F.map_concat(env, F.create_map(F.lit(script_key), step["script"]))).otherwise(env)


def effective_env(job_meta: Column, step_meta: Column, reserved: Column) -> Column:
    return overlay(overlay(job_meta, step_meta), reserved)


def env_rows(env: Column) -> Column:
    """(name, value) structs sorted by name."""
    entries = F.array_sort(F.map_entries(env))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))


def priority_metadata(meta: Column, priority: Column, key: str = "priority", name_key: str = "priorityName") -> Column:
    """Stamp the numeric priority and its bucket name on a metadata map."""
    bucket = priority_bucket(priority)
    stamped = F.create_map(F.lit(key), priority_rank(bucket).cast("string"), F.lit(name_key), bucket)
    return overlay(meta, stamped)


def label_priority(labels: Column, key: str = "priority", default: int = 1) -> Column:
    text = F.regexp_replace(F.try_element_at(labels, F.lit(key)), r"(?U)^\s+|\s+\z", "")
    value = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))
    return F.when(value >= 1, value).otherwise(F.lit(default)).cast("bigint")


# --- resources -----------------------------------------------------------------------------


def effective_resources(step, cpu_default: int = 0, memory_default: str = "") -> dict[str, Column]:
    """The limits a step runs with, given the executor's own limits. NULL = not set."""
    cpu = find_limit(F.coalesce(step["cpu_limit"], F.lit(0)), F.lit(cpu_default)).cast("bigint")
    memory = find_memory_limit(F.coalesce(step["memory_limit"], F.lit("")), F.lit(memory_default))
    return {
        "cpu": F.nullif(cpu, F.lit(0)),
        "nano_cpus": F.nullif(cpu * F.lit(1_000_000_000), F.lit(0)),
        "memory_bytes": F.nullif(memory, F.lit(0)),
        "swap_bytes": memory_limit_bytes(step["memory_swap"]),
        "pids": F.when(step["pids_limit"] > 0, step["pids_limit"]),
        "network_mode": empty_to_null(step["network"]),
    }


def effective_requests(cpu_limit: Column, memory_limit: Column, cpu_request: Column, memory_request: Column):
    """Limits stand in for the requests only when no request at all is set."""
    none = cpu_request.isNull() & memory_request.isNull()
    return {
        "cpu_request": F.when(none, cpu_limit).otherwise(cpu_request),
        "memory_request": F.when(none, memory_limit).otherwise(memory_request),
    }


def clamp_timeout(seconds: Column) -> Column:
    """NULL = no timeout."""
    return F.when(seconds > 0, F.least(seconds, F.lit(S.MAX_TIMEOUT_SECONDS)))


# --- ids, states, texts and times ----------------------------------------------------------


def truncate_id(c: Column, n: int = 8) -> Column:
    return F.substring(c, 1, n)


_HEX = "[0-9a-f]"
_DASHED = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"


def canonical_job_id(c: Column) -> Column:
    """Canonical lower-case UUID, or NULL for anything that is not one.

    Accepted: the hyphenated form, the same behind ``urn:uuid:``, the same between one character on either
    side (braces by convention, not checked), and 32 bare hex digits.
    """
    low, size = F.lower(c), F.octet_length(c)
    dashed = (
        F.when(size == 36, low)
        .when((size == 45) & low.startswith("urn:uuid:"), F.substring(low, 10, 36))
        .when(size == 38, F.substring(low, 2, 36))
        .when(size == 32, F.regexp_replace(low, f"^({_HEX}{{8}})({_HEX}{{4}})({_HEX}{{4}})({_HEX}{{4}})({_HEX}{{12}})\\z", "$1-$2-$3-$4-$5"))
    )
    return F.when(dashed.rlike(f"^{_DASHED}\\z"), dashed)


def container_state(waiting: Column, running: Column, exit_code: Column) -> Column:
    return (
        F.when(waiting, "Pending")
        .when(running, "Running")
        .when(exit_code == 0, "Succeeded")
        .when(exit_code.isNotNull(), "Failed")
        .otherwise("Unknown")
    )


def timeout_reason(seconds: Column) -> Column:
    return F.concat(F.lit("job timed out after "), seconds.cast("string"), F.lit(" seconds"))


def job_time(finished: Column, started: Column, queued: Column) -> Column:
    return F.coalesce(finished, started, queued)


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds, truncated toward zero; NULL when either end is missing."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.call_function("div", micros, F.lit(1000))


def duration_ms(started: Column, finished: Column, as_of: Column) -> Column:
    return millis_between(started, F.coalesce(finished, as_of))


def format_duration(ms: Column) -> Column:
    seconds = F.floor((ms + 500) / 1000)
    tenths = F.floor((ms + 50) / 100)
    return (
        F.when(ms.isNull(), "-")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
    )


def relative_time(ts: Column, as_of: Column) -> Column:
    diff = millis_between(ts, as_of)
    s = F.floor((diff + 500) / 1000)
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit + " ago"))
    return (
        F.when(diff.isNull(), "-")
        .when(ts.cast("timestamp") > as_of.cast("timestamp"), "just now")
        .when(s < 60, ago(s, "s"))
        .when(s < 3600, ago(s / 60, "m"))
        .when(s < 86400, ago(s / 3600, "h"))
        .otherwise(ago(s / 86400, "d"))
    )
