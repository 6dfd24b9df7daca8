"""Column expressions that mask secrets in metadata values and free text."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtrail.functions.scalars import empty_map, let, sanitize_callback_url

# Fixed value: what a masked value is shown as.
MASK = "••••••"

# Words that mark a key as sensitive, in metadata keys and in KEY=VALUE text.
KEY_WORDS = "token|passwd|password|pwd|secret|api[_-]?key|access[_-]?key|credential|auth|private|cert|signing|session"
TEXT_WORDS = "token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|credential|auth|private|signing|session"


def _folded(words: str) -> str:
    """Spell out the two non-ASCII letters that fold to s and k; Java's own Unicode folding adds others."""
    return words.replace("s", "[sſ]").replace("k", "[k\u212a]")


# Patterns that decide what is a secret. Written for Java: \s is spelled out because Java's
# has one more character. So that long texts take linear time, quantifiers are possessive where the next
# character cannot extend the run, a run of characters is only tried from its start, and a key only where
# its run is followed by a sign of assignment. None of this changes what matches.
DEFAULT_KEY_PATTERN = f"(?i)({_folded(KEY_WORDS)})"
_SCHEME = r"(?<![a-zA-Z0-9+.\-])[0-9+.\-]*+[a-zA-Z][a-zA-Z0-9+.\-]*+"
_CREDENTIALS_IN_URL = _SCHEME + r"://[^/\t\n\f\r :@]++:[^/\t\n\f\r @]++@"
_URL_PASSWORD = rf"({_SCHEME}://[^/\t\n\f\r :@]++:)([^/\t\n\f\r @]++)(@)"
_JWT = r"^[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}\z"
_JWT_INLINE = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}"
_TOKEN = r"^[A-Za-z0-9+/=_\-]+\z"
_LONG_TOKEN = r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/=_\-]{24,}+"
_PEM_BLOCK = r"(?s)-----BEGIN[^-]*-----.*?-----END[^-]*-----"
_TO_LAST_END = r"(?s)\A(.*-----END[^-]*-----)"
_BLANK, _WORD = r"[\t\n\f\r ]", "[a-z0-9_.\\-ſ\u212a]"
_ASSIGNMENT = (
    rf"(?i)((?:^|[\t\n\f\r ;&|(])(?:export{_BLANK}+|[sſ]et{_BLANK}+|-e{_BLANK}+)?"
    rf"(?={_WORD}++{_BLANK}*+[:=]){_WORD}*(?:{_folded(TEXT_WORDS)}){_WORD}*+{_BLANK}*+[:=]{_BLANK}*)([\"']?)([^\t\n\f\r \"';]+)"
)
_MIN_TOKEN_BYTES = 24
_MIN_ENTROPY = 3.5

MODES = ("smart", "all")


def shannon_entropy(c: Column) -> Column:
    """Bits per byte, rounded to 12 digits so that the threshold does not hang on the order of a sum."""

    def of_bytes(text: Column) -> Column:
        n = F.length(text).cast("double")

        def add(acc: Column, char: Column) -> Column:
            p = (n - F.length(F.replace(text, char, F.lit("")))) / n
            return acc - p * F.log2(p)

        chars = F.array_distinct(F.filter(F.split(text, ""), lambda x: x != ""))
        return F.when(text == "", F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), add))

    # One character per byte.
    return F.round(let(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), of_bytes), 12)


def secret_rule(value: Column) -> Column:
    """The first content rule that fires on a value, or NULL."""
    token = (F.octet_length(value) >= _MIN_TOKEN_BYTES) & value.rlike(_TOKEN)
    return (
        F.when(value.contains("://") & value.rlike(_CREDENTIALS_IN_URL), "url_credentials")
        .when(value.contains("-----BEGIN"), "pem")
        .when(value.rlike(_JWT), "jwt")
        .when(token & (shannon_entropy(value) >= _MIN_ENTROPY), "entropy")
    )


def looks_like_secret(value: Column) -> Column:
    return secret_rule(value).isNotNull()


def _check(mode: str, key_pattern: str | None) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    pattern = key_pattern or DEFAULT_KEY_PATTERN
    # Fail when the query is built, not on an executor.
    re.compile(pattern.replace(r"\z", r"\Z"))
    return pattern


def masking_rule(key: Column, value: Column, mode: str = "smart", key_pattern: str | None = None) -> Column:
    """Why a metadata value is masked (mode, key or a content rule); NULL when it is shown."""
    pattern = _check(mode, key_pattern)
    rule = F.lit("mode") if mode == "all" else F.when(key.rlike(pattern), "key").otherwise(secret_rule(value))
    return F.when(value != "", rule)


def redact_value(key: Column, value: Column, mode: str = "smart", key_pattern: str | None = None) -> Column:
    """struct(display, masked)."""
    masked = masking_rule(key, value, mode, key_pattern).isNotNull()
    return F.struct(F.when(masked, F.lit(MASK)).otherwise(value).alias("display"), masked.alias("masked"))


def redact_metadata(meta: Column, mode: str = "smart", key_pattern: str | None = None) -> Column:
    return F.transform_values(meta, lambda k, v: redact_value(k, v, mode, key_pattern)["display"])


def redact_text(text: Column) -> Column:
    """Mask URL passwords, sensitive assignments, PEM blocks, JWTs and long high-entropy tokens, in that order."""

    def mask_blocks(clean: Column) -> Column:
        # Up to the last end line every begin line finds its end; behind it none would, however far it looked.
        head = F.regexp_extract(clean, _TO_LAST_END, 1)
        masked = F.concat(F.regexp_replace(head, _PEM_BLOCK, MASK), F.substring(clean, F.length(head) + 1, F.length(clean)))
        return F.when(clean.contains("-----BEGIN") & clean.contains("-----END"), masked).otherwise(clean)

    s = F.when(text.contains("://"), F.regexp_replace(text, _URL_PASSWORD, f"$1{MASK}$3")).otherwise(text)
    s = F.regexp_replace(s, _ASSIGNMENT, f"$1$2{MASK}")
    s = F.regexp_replace(let(s, mask_blocks), _JWT_INLINE, MASK)

    def mask_tokens(clean: Column) -> Column:
        gaps = F.split(clean, _LONG_TOKEN, -1)
        tokens = F.regexp_extract_all(clean, F.lit(f"({_LONG_TOKEN})"), F.lit(1))
        shown = lambda t: F.when(shannon_entropy(t) >= _MIN_ENTROPY, F.lit(MASK)).otherwise(t)
        pieces = F.zip_with(gaps, tokens, lambda g, t: F.concat(g, F.coalesce(shown(t), F.lit(""))))
        return F.when(clean.rlike(_LONG_TOKEN), F.array_join(pieces, "")).otherwise(clean)

    return let(s, mask_tokens)


def masked_spans(redacted: Column) -> Column:
    """How many masks a redacted text shows."""
    return F.call_function("div", F.length(redacted) - F.length(F.replace(redacted, F.lit(MASK), F.lit(""))), F.lit(len(MASK)))


def redact_steps(steps: Column, mode: str = "smart", key_pattern: str | None = None) -> Column:
    def one(s: Column) -> Column:
        return s.withField("metadata", redact_metadata(s["metadata"], mode, key_pattern)).withField(
            "script", redact_text(s["script"])
        )

    return F.transform(steps, one)


def safe_job_json(job) -> Column:
    """A job as JSON without any metadata and with a bare callback URL. ``job`` is a row of JOB columns."""
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0))
    bare = F.transform(
        job["steps"],
        lambda s: F.struct(
            number(s["id"]).alias("id"),
            text(s["name"]).alias("name"),
            text(s["image"]).alias("image"),
            text(s["script"]).alias("script"),
            F.coalesce(s["continue_on_error"], F.lit(False)).alias("continue_on_error"),
            empty_map().alias("metadata"),
            number(s["cpu_limit"]).alias("cpu_limit"),
            text(s["memory_limit"]).alias("memory_limit"),
            F.nullif(s["network"], F.lit("")).alias("network"),
            F.nullif(s["memory_swap"], F.lit("")).alias("memory_swap"),
            F.nullif(s["pids_limit"], F.lit(0)).alias("pids_limit"),
        ),
    )
    row = F.struct(
        job["id"].alias("id"),
        text(job["name"]).alias("name"),
        job["timestamp"].alias("timestamp"),
        empty_map().alias("metadata"),
        bare.alias("steps"),
        F.nullif(sanitize_callback_url(job["callback_url"]), F.lit("")).alias("callback_url"),
        F.nullif(job["timeout_seconds"], F.lit(0)).alias("timeout_seconds"),
    )
    return F.to_json(row)


def failure_reason(error: Column, timed_out: Column, timeout_seconds: Column, max_chars: int) -> Column:
    """Displayable reason of a failed job: redacted, and cut to ``max_chars`` code points plus an ellipsis."""
    from jobtrail.functions.scalars import timeout_reason

    text = F.when(timed_out & (timeout_seconds > 0), timeout_reason(timeout_seconds)).otherwise(redact_text(error))
    cut = lambda t: F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit("…"))).otherwise(t)
    return let(text, cut)
