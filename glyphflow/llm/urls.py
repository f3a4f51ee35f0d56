"""URL rules found by their rarest literal token, in DataFrame operations only.

A rule names a host with its subdomains and the start of a path, or is a pattern in the notation of filter lists. Every rule is
filed under the one of its literal tokens that the URLs hold least often; a URL's tokens fetch the rules filed under them, and
only those run their regular expression.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, table

#: (action, host, path). The longest rule that fits wins.
BASE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: What no base rule decides. "||" begins a host or one of its labels, "|" the host or the end, "*" is anything, "^" a separator or
#: the end, "@@" an exception, which wins; all else is literal, in any case. Fixed values of this engine.
PATTERN_RULES = (
    "^casino^", "^casinos^", "^poker^", "^slots^", "^jackpot^", "^betting^", "^free-bets^", "^bets^", "^porn^", "^xxx^", "^sex^", "^adult^", "^camgirls^", "^escorts^",
    "^viagra^", "^cialis^", "^pills^", "^cheap-meds^", "^payday^", "^quick-loans^", "^spam^", "^malware^", "^phishing^", "^warez^", "^crack^", "^keygen^", "^torrent^", "^torrents^",
    "||doubleclick.net^", "||googlesyndication.com^", "||adservice.*^", "||ads.*^", "||adserver.*^", "||tracker.*^", "||pixel.*^", "||click.*/redirect^", "||t.co^", "||bit.ly^",
    "^adframe^", "^banners/ads^", "^popunder^", "^utm_redirect^", "/wp-login.php|", "/wp-admin/*", "/xmlrpc.php|", "/cgi-bin/*.exe|", "*.apk|", "*.exe|", "*.scr|", "^login-verify^", "^verify-account^", "^account-suspended^",
    "@@^sex-education^", "@@^responsible-gambling^", "@@^malware-research^", "@@^phishing-awareness^", "@@||wikipedia.org^", "@@||gov^",
)

RULE_SCHEMA = "array<struct<rule string, action string, pattern string, tokens array<string>, weight int>>"
#: What a token ends at; the letters that "^" stands for none of.
TOKEN, SEPARATOR = "[a-z0-9]+", r"[^a-z0-9_.%]"


def parsed(rule: str) -> tuple[str, str, list[str]]:
    """Action, regular expression over lower-cased host and path, and the tokens that every match holds whole."""
    action, body = ("allow", rule[2:]) if rule.startswith("@@") else ("block", rule)
    body = body.lower()
    start, body = ("label", body[2:]) if body.startswith("||") else ("begin", body[1:]) if body.startswith("|") else ("", body)
    ends, body = (True, body[:-1]) if body.endswith("|") else (False, body)
    head = {"label": r"\A(?:[^/]*\.)?", "begin": r"\A", "": ""}[start]
    # A separator before the rule may also be the beginning of the host, or a point between its labels.
    if not start and body.startswith("^"):
        head, body, start = r"(?:\A|[^a-z0-9_%])", body[1:], "begin"
    out, tokens = "", []
    for m in re.finditer(rf"{TOKEN}|.", body, re.DOTALL):
        out += ".*" if m[0] == "*" else rf"(?:{SEPARATOR}|\.|\z)" if m[0] == "^" else re.escape(m[0])
        before, after = body[m.start() - 1 : m.start()], body[m.end() : m.end() + 1]
        if re.fullmatch(TOKEN, m[0]) and before != "*" and after != "*" and (before or start) and (after or ends):
            tokens.append(m[0])
    return action, rf"(?s){head}{out}" + (r"\z" if ends else ""), sorted(set(tokens))


def literal_tokens(host: str, path: str) -> list[str]:
    """Tokens that every URL a rule fits holds whole: of the host, and of the path but for an end that may go on."""
    return sorted(set(re.findall(TOKEN, host.lower()) + re.findall(TOKEN, re.sub(rf"{TOKEN}\Z", "", path.lower()))))


def rule_rows(rules=BASE_RULES, patterns=PATTERN_RULES) -> list[dict]:
    """Rules given by host and path weigh more than any pattern, among themselves by length; then exceptions, then the others."""
    rows = [(host + path, action, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", literal_tokens(host, path), 1 + len(host + path)) for action, host, path in rules]
    for rule in patterns:
        action, pattern, tokens = parsed(rule)
        rows.append((None, action, pattern, tokens, 0 if action == "allow" else -1))
    return [dict(zip(("rule", "action", "pattern", "tokens", "weight"), r, strict=True)) for r in rows]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: list[dict] | None = None, url_col: str = "url", most_rules: int = 100_000) -> DataFrame:
    """The pages with host, path, rule and verdict added (columns of those names are replaced).

    Null url or one without "://": host and path empty, rule null, verdict allow. Rules of equal weight: the smaller name
    wins. A rule without a whole literal token is filed under "", which every URL holds. Base rules are tested on the path as it
    is, patterns on lower-cased text. Repeated rows and all other columns stay. `rules`, as rule_rows makes them, come from the
    driver as a literal and are bounded by `most_rules`; Spark broadcasts their index while it is small and shuffles beyond.
    """
    rows = rule_rows() if rules is None else rules
    if len(rows) > most_rules:
        raise ValueError(f"{len(rows)} rules; the bound is {most_rules}")
    clash = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")]
    pages = pages.withColumns({fresh(pages, "_host"): host_of(F.col(f"`{url_col}`")), fresh(pages, "_path"): path_of(F.col(f"`{url_col}`"))})
    (host, path), best = pages.columns[-2:], fresh(pages, "_best")
    pages = pages.drop(*clash)
    urls = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path")).distinct()
    tokens = F.array_distinct(F.split(lower_ascii(F.concat("host", "path")), "[^a-z0-9]+"))
    held = urls.select("host", "path", F.explode(F.array_union(F.array(F.lit("")), tokens)).alias("token"))
    known = pages.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(rows)), RULE_SCHEMA)).alias("id", "r")).select("id", "r.*")
    filed = known.select("id", F.explode("tokens").alias("token"))
    counts = held.join(filed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = filed.join(counts, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("best"))
    index = known.join(rarest, "id", "left").select(F.coalesce("best.token", F.lit("")).alias("token"), "rule", "action", "pattern", "weight")
    fits = "rlike(IF(weight > 0, concat(host, path), translate(concat(host, path), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), pattern)"
    hits = held.join(index, "token").where(fits)
    won = hits.groupBy("host", "path").agg(F.min(F.struct(-F.col("weight"), "rule", "action")).alias(best))
    won = won.withColumnsRenamed({"host": host, "path": path})
    out = pages.join(won, [host, path], "left")
    kept = [c for c in pages.columns if c not in (host, path)]
    return out.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"), F.col(f"`{best}`.rule").alias("rule"), F.coalesce(F.col(f"`{best}`.action"), F.lit("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}'"
        for _, host, path in sorted(BASE_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    actions = " ".join(f"WHEN '{host}{path}' THEN '{action}'" for action, host, path in BASE_RULES)
    found = {"allow": [], "block": []}
    for action, pattern, _ in map(parsed, PATTERN_RULES):
        found[action].append(pattern.replace("'", "''"))
    any_of = lambda action: " OR ".join(f"regexp_matches(low, '{p}')" for p in found[action])
    return f"""
    WITH p AS (SELECT page_id,
            translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT *, CASE {fits} END AS rule, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM p)
    SELECT page_id, host, path, rule, CASE rule {actions}
        ELSE CASE WHEN {any_of('allow')} THEN 'allow' WHEN {any_of('block')} THEN 'block' ELSE 'allow' END END AS verdict FROM r"""
