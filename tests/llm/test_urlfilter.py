import random
import re

from millrace.llm import urlfilter
from millrace.llm.registry import URL_GLOBS, URL_RULES

SCHEMA = "page_id long, url string, host string, rule string"


def as_regex(glob):
    parts = {"**": "(?s:.*)", "*": "[^/]*", "?": "(?s:.)"}
    return re.compile("".join(parts.get(t) or re.escape(t) for t in re.findall(r"\*\*|\*|\?|[^*?]", glob)).encode())


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), -k) for k, (_, h, p) in enumerate(URL_RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        verdict, h, p = URL_RULES[-max(fits)[1]]
        return host, path, h + p, verdict
    verdict = next((v for v, g in URL_GLOBS if as_regex(g).fullmatch((host + path).encode())), "allow")
    return host, path, None, verdict


def urls():
    rng = random.Random(8)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "notexample.com", "net", "x.net", "casino.org", "É.net", "a.b", ""]
    paths = ["", "/", "/en/", "/en", "/en/1", "/es/x.example.com/en/", "/fr/", "/login", "/a/b.exe", "/*?", "/x/com/", "/.net/es/"]
    tails = ["", "?q=/en/", "#://net/es/", "?a#b"]
    out = [None, "", "no scheme", "://", "http:/x", "http://", "x" * 100_000, "http://e.com/" + "y" * 200_000]
    out += [rng.choice(["http://", "https://", "", "a://b://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(tails) for _ in range(3000)]
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(urls())) + [(None, "http://x.com/"), (1, "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = urlfilter.judge_urls(df, URL_RULES, URL_GLOBS).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = [(i, *brute(u)) for i, u in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert urlfilter.judge_urls(spark.createDataFrame([], SCHEMA), URL_RULES, URL_GLOBS).collect() == []


def test_globs_against_regexes():
    rng = random.Random(2)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    texts = ["".join(rng.choice("ab/é") for _ in range(rng.randint(0, 12))).encode() for _ in range(300)]
    machine = urlfilter.compile_globs(globs)
    assert machine.accepts.shape[1] > 8  # several words, so the shift must carry
    hit = machine.matches(texts)
    for k, glob in enumerate(globs):
        regex = as_regex(glob)
        assert [bool(x) for x in hit[:, k]] == [bool(regex.fullmatch(t)) for t in texts], glob
    assert machine.matches([]).shape == (0, 150)
