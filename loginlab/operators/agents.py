"""User agents classified by a table of rules.

A rule is a kind (os, app, browser, or any other), a priority, a regular expression and the name it stands
for. Of the rules of a kind the first that matches decides. From every expression follow literals of which
one must occur in a text that matches; one automaton over all literals finds, in a single pass over
an agent, the few rules that are worth trying. Each distinct agent is looked at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlab.operators.enrich import OTHER

RULES_AT_ONCE = 50_000  # rules that go to a task together
FIELDS = "kind string, priority int, pattern string, name string, version_pattern string"

# fixed values: kind, pattern, name, pattern of the version; the first match of a kind decides
RULES = [
    ("os", r"Windows Phone", "Windows Phone", None),
    ("os", r"Xbox", "Xbox", None),
    ("os", r"Windows", "Windows", None),
    ("os", r"Apple ?TV|tvOS", "tvOS", None),
    ("os", r"Watch OS|watchOS", "watchOS", None),
    ("os", r"iPhone|iPad|iPod|CFNetwork.*Mobile", "iOS", None),
    ("os", r"Mac OS X|Macintosh|Darwin", "Mac OS X", None),
    ("os", r"KAIOS", "KaiOS", None),
    ("os", r"HarmonyOS", "HarmonyOS", None),
    ("os", r"Tizen", "Tizen", None),
    ("os", r"[Ww]eb0?OS", "webOS", None),
    ("os", r"PlayStation", "PlayStation", None),
    ("os", r"Android|Dalvik", "Android", None),
    ("os", r"CrOS", "Chrome OS", None),
    ("os", r"BlackBerry|BB10", "BlackBerry", None),
    ("os", r"Ubuntu", "Ubuntu", None),
    ("os", r"Fedora", "Fedora", None),
    ("os", r"Debian", "Debian", None),
    ("os", r"FreeBSD", "FreeBSD", None),
    ("os", r"OpenBSD", "OpenBSD", None),
    ("os", r"SunOS", "Solaris", None),
    ("os", r"Linux|X11", "Linux", None),
    ("app", r"[Bb]ot\b|[Ss]pider|[Cc]rawler", "unknown", None),
    ("app", r"Windows NT|Macintosh|X11|CrOS", "desktop", None),
    ("app", r"iPhone|iPod|Android.*Mobile|Windows Phone|BlackBerry|KAIOS", "mobileweb", None),
    ("browser", r"Googlebot", "Googlebot", r"Googlebot/([0-9.]+)"),
    ("browser", r"bingbot", "bingbot", r"bingbot/([0-9.]+)"),
    ("browser", r"YandexBot", "YandexBot", r"YandexBot/([0-9.]+)"),
    ("browser", r"Baiduspider", "Baiduspider", r"Baiduspider/([0-9.]+)"),
    ("browser", r"DuckDuckBot", "DuckDuckBot", r"DuckDuckBot/([0-9.]+)"),
    ("browser", r"Applebot", "Applebot", r"Applebot/([0-9.]+)"),
    ("browser", r"AhrefsBot", "AhrefsBot", r"AhrefsBot/([0-9.]+)"),
    ("browser", r"facebookexternalhit", "FacebookBot", r"facebookexternalhit/([0-9.]+)"),
    ("browser", r"FBAV/", "Facebook", r"FBAV/([0-9.]+)"),
    ("browser", r"Instagram ", "Instagram", r"Instagram ([0-9.]+)"),
    ("browser", r"Edg(?:e|A|iOS)?/", "Edge", r"Edg(?:e|A|iOS)?/([0-9.]+)"),
    ("browser", r"OPR/|Opera", "Opera", r"(?:OPR|Opera)/([0-9.]+)"),
    ("browser", r"Vivaldi/", "Vivaldi", r"Vivaldi/([0-9.]+)"),
    ("browser", r"YaBrowser/", "Yandex Browser", r"YaBrowser/([0-9.]+)"),
    ("browser", r"UCBrowser/", "UC Browser", r"UCBrowser/([0-9.]+)"),
    ("browser", r"MiuiBrowser/", "MiuiBrowser", r"MiuiBrowser/([0-9.]+)"),
    ("browser", r"DuckDuckGo/", "DuckDuckGo", r"DuckDuckGo/([0-9.]+)"),
    ("browser", r"SamsungBrowser/", "Samsung Internet", r"SamsungBrowser/([0-9.]+)"),
    ("browser", r"GSA/", "Google", r"GSA/([0-9.]+)"),
    ("browser", r"CriOS/", "Chrome Mobile iOS", r"CriOS/([0-9.]+)"),
    ("browser", r"FxiOS/", "Firefox iOS", r"FxiOS/([0-9.]+)"),
    ("browser", r"SeaMonkey/", "SeaMonkey", r"SeaMonkey/([0-9.]+)"),
    ("browser", r"Thunderbird/", "Thunderbird", r"Thunderbird/([0-9.]+)"),
    ("browser", r"Mobile.*Firefox/", "Firefox Mobile", r"Firefox/([0-9.]+)"),
    ("browser", r"Firefox/", "Firefox", r"Firefox/([0-9.]+)"),
    ("browser", r"Microsoft Outlook|Outlook-", "Outlook", r"Outlook[ -](?:iOS/)?([0-9.]+)"),
    ("browser", r"HeadlessChrome", "HeadlessChrome", r"HeadlessChrome/([0-9.]+)"),
    ("browser", r"Electron/", "Electron", r"Electron/([0-9.]+)"),
    ("browser", r"; wv\).*Chrome/", "Chrome Mobile WebView", r"Chrome/([0-9.]+)"),
    ("browser", r"Chrome/.*Mobile", "Chrome Mobile", r"Chrome/([0-9.]+)"),
    ("browser", r"Chromium/", "Chromium", r"Chromium/([0-9.]+)"),
    ("browser", r"Chrome/", "Chrome", r"Chrome/([0-9.]+)"),
    ("browser", r"Version/.*Mobile.*Safari/", "Mobile Safari", r"Version/([0-9.]+)"),
    ("browser", r"(?:iPhone|iPad|iPod).*AppleWebKit", "Mobile Safari UI/WKWebView", None),
    ("browser", r"Version/.*Safari/", "Safari", r"Version/([0-9.]+)"),
    ("browser", r"MSIE |Trident/", "IE", r"(?:MSIE |rv:)([0-9.]+)"),
    ("browser", r"PhantomJS/", "PhantomJS", r"PhantomJS/([0-9.]+)"),
    ("browser", r"python-requests/", "Python Requests", r"python-requests/([0-9.]+)"),
    ("browser", r"[Pp]ython-urllib", "Python-urllib", r"[Pp]ython-urllib[0-9]?/([0-9.]+)"),
    ("browser", r"aiohttp/", "aiohttp", r"aiohttp/([0-9.]+)"),
    ("browser", r"okhttp/", "okhttp", r"okhttp/([0-9.]+)"),
    ("browser", r"Go-http-client/", "Go-http-client", r"Go-http-client/([0-9.]+)"),
    ("browser", r"Apache-HttpClient/", "Apache-HttpClient", r"Apache-HttpClient/([0-9.]+)"),
    ("browser", r"Java/", "Java", r"Java/([0-9._]+)"),
    ("browser", r"PostmanRuntime/", "PostmanRuntime", r"PostmanRuntime/([0-9.]+)"),
    ("browser", r"PowerShell/", "PowerShell", r"PowerShell/([0-9.]+)"),
    ("browser", r"libwww-perl", "libwww-perl", r"libwww-perl/([0-9.]+)"),
    ("browser", r"Wget/", "Wget", r"Wget/([0-9.]+)"),
    ("browser", r"curl/", "curl", r"curl/([0-9.]+)"),
]
MISSING = {"os": OTHER, "app": "unknown", "browser": OTHER}

#: A-Z, and the two letters beyond ASCII that match one of them where case is ignored
_PLAIN = {**{ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, 0x212A: "k", 0x17F: "s"}


def _needed(parsed) -> frozenset[str]:
    """Literals of which one must occur, the shortest as long as possible; empty if there are none."""
    best: frozenset[str] = frozenset()
    run = ""

    def offer(choice):
        nonlocal best
        if choice and min(map(len, choice)) > min(map(len, best), default=0):
            best = frozenset(choice)

    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            run += chr(value)
            continue
        offer({run} if run else ())
        run = ""
        if name == "SUBPATTERN":
            offer(_needed(value[-1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            offer(_needed(value[2]))
        elif name == "ATOMIC_GROUP":
            offer(_needed(value))
        elif name == "BRANCH":
            sides = [_needed(side) for side in value[1]]
            if all(sides):
                offer(frozenset().union(*sides))
    offer({run} if run else ())
    return best


def needed_literals(pattern: str) -> frozenset[str]:
    """What a text has to contain, one of it at least, to match; letters A-Z as small ones."""
    found = _needed(re._parser.parse(pattern))
    return frozenset(x.translate(_PLAIN) for x in found) if all(x.isascii() for x in found) else frozenset()


class Matcher:
    """Rules ⟨kind, priority, pattern, name, version pattern⟩, compiled."""

    def __init__(self, rules: list[tuple]):
        self.rules = sorted(rules, key=lambda r: (r[0], r[1], r[2], r[3]))
        self.patterns = [re.compile(r[2]) for r in self.rules]
        self.versions = [re.compile(r[4]) if r[4] else None for r in self.rules]
        self.always: list[int] = []
        by_literal: dict[str, list[int]] = {}
        for k, rule in enumerate(self.rules):
            needed = needed_literals(rule[2])
            for literal in needed:
                by_literal.setdefault(literal, []).append(k)
            if not needed:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for literal, rules_ in by_literal.items():
            self.automaton.add_word(literal, rules_)
        if by_literal:
            self.automaton.make_automaton()
        self.tried = 0

    def match(self, agent: str) -> list[tuple]:
        """⟨kind, priority, pattern, name, version⟩ of the first matching rule of each kind."""
        worth = set(self.always)
        if len(self.automaton):
            for _, found in self.automaton.iter(agent.translate(_PLAIN)):
                worth.update(found)
        out: dict[str, tuple] = {}
        for k in sorted(worth):
            kind, priority, pattern, name, _ = self.rules[k]
            if kind in out:
                continue
            self.tried += 1
            if self.patterns[k].search(agent):
                version = self.versions[k].search(agent) if self.versions[k] else None
                out[kind] = (kind, priority, pattern, name, version[1] if version else "")
        return list(out.values())


def rule_table(spark, rules=RULES) -> DataFrame:
    """The rules of a list as a table; places in the list become priorities."""
    return spark.createDataFrame([(k, n, p, name, v) for n, (k, p, name, v) in enumerate(rules)], FIELDS)


def classify(agents: DataFrame, rules: DataFrame) -> DataFrame:
    """⟨user_agent, kind, name, version⟩ for every distinct agent and every kind of which a rule matches. Of rules with
    equal priorities the first pattern counts. Null agents and rules without kind, pattern or name say nothing."""
    distinct = agents.where("user_agent IS NOT NULL").select("user_agent").distinct()
    rules = rules.select(*[f.split()[0] for f in FIELDS.split(", ")]).dropna(subset=["kind", "pattern", "name"])
    rules = rules.distinct()
    slices = max(1, -(-rules.count() // RULES_AT_ONCE))
    fields = "user_agent string, kind string, priority int, pattern string, name string, version string"
    found = None
    for k in range(slices):
        part = rules.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == k)
        chosen = [tuple(r) for r in part.collect()]
        for rule in chosen:
            re.compile(rule[2])  # a faulty expression fails here

        def look(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(chosen)
            for batch in batches:
                rows = [(a, *m) for a in batch["user_agent"].to_pylist() for m in matcher.match(a)]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
                columns = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in fields.split(", ")]
                )

        more = distinct.mapInArrow(look, fields)
        found = more if found is None else found.unionByName(more)
    if slices > 1:
        first = F.min_by(F.struct("name", "version"), F.struct("priority", "pattern", "name"))
        found = found.groupBy("user_agent", "kind").agg(first.alias("f")).select("user_agent", "kind", "f.*")
    return found.select("user_agent", "kind", "name", "version")


def user_agent_dimension(attempts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per distinct user agent with its os, app and browser."""
    found = classify(attempts, rules).groupBy("user_agent").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("name"))).alias(k) for k in MISSING],
        F.max(F.when(F.col("kind") == "browser", F.col("version"))).alias("browser_version"),
    )
    distinct = attempts.where("user_agent IS NOT NULL").select("user_agent").distinct()
    named = [F.coalesce(k, F.lit(v)).alias(k) for k, v in MISSING.items()]
    return distinct.join(found, "user_agent", "left").select(
        "user_agent", *named, F.coalesce("browser_version", F.lit("")).alias("browser_version")
    )


def _names(attempts: DataFrame, rules: DataFrame, by) -> DataFrame:
    """Group, kind, name, attempts; counted per user agent before anything is looked up."""
    counted = attempts.where("user_agent IS NOT NULL").groupBy(*by, "user_agent").agg(F.count("*").alias("n"))
    known = user_agent_dimension(attempts, rules)
    named = F.create_map(*[x for k in MISSING for x in (F.lit(k), F.col(k))])
    return (
        counted.join(known, "user_agent")
        .select(*by, "n", F.explode(named).alias("kind", "name"))
        .groupBy(*by, "kind", "name")
        .agg(F.sum("n").alias("n"))
    )


def user_agent_counts(attempts: DataFrame, rules: DataFrame, by=("client_ip", "d")) -> DataFrame:
    """⟨group, kind, name, n⟩: attempts per os, app and browser, as rows: a table of rules has any number of names."""
    return _names(attempts, rules, by)


def user_agent_vocabulary(attempts: DataFrame, rules: DataFrame) -> DataFrame:
    return _names(attempts, rules, []).select("name").distinct()
