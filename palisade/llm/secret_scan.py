"""Secret scan: candidate strings judged by a random forest, in one projection.

Candidates are found by one pattern: any value of 8 or more characters after a key word
and an assignment (in quotes with spaces too) or in a sentence that states it, the password
in an address, a private key from its first line to its last, and runs of 16 or more key
characters.
Each has numbers: length, transitions between kinds of characters, share covered by
dictionary words, signs of a path or a sentence, and the words before and behind it. A
forest, grown from labelled findings that `labelled_findings` spells out for each known
kind, becomes one SQL expression over those numbers, so that texts are read once and never
shuffled.

Results for special rows: a null text stays null and has no candidates; an empty text
has none; repeated rows, and rows with a null id, give results of their own; other columns
are kept by `redact`, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = r"(?i:token|secret|passw|passphrase|passcode|pwd|\bpw\b|api.?key|access.?key|auth|bearer|credential|private|signature)"
#: The place of a value: the first look is cheap, the second one goes back to the key word.
ASSIGNED = rf"(?<=[=:>][ \t\"']{{0,4}})(?<={KEYS}[^\n=:]{{0,13}}[=:]{{1,2}}>?[ \t]{{0,3}}[\"']?)"
#: The password in an address with credentials, and a value that a sentence states; the first look is cheap again.
IN_ADDRESS = r"(?<=:)(?<=://[^\s:/@\"']{0,64}:)[^\s:/@\"']{6,}(?=@)"
STATED = r"(?<=is:?[ ])(?<=(?i:password|passphrase|passcode|passwd|pwd|secret|token|api key)[ ]is:?[ ])[^\s\"']{7,}[^\s\"',;.:)\]}>]"
#: A private key from its first line to its last; a dash inside is passed over one at a time, without going back.
KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
CANDIDATE = (
    rf"{KEY_BLOCK}|{IN_ADDRESS}|{STATED}|{ASSIGNED}(?:(?<=\")[^\"\n]{{8,200}}(?=\")|(?<=')[^'\n]{{8,200}}(?=')|[^\s\"']{{7,}}[^\s\"',;.:)\]}}>])"
    r"|(?<![A-Za-z0-9+/_.-])(?=[+/_.-]*[A-Za-z0-9])[A-Za-z0-9+/_.-]{16,}={0,2}"
)
#: Characters before and behind a candidate whose words are its neighbours.
BEFORE, BEHIND = 48, 24
MARK = "[SECRET]"
#: Labelled findings of all kinds together; trees, and levels of a tree.
FINDINGS, TREES, LEVELS, LEAF = 1200, 15, 5, 4
SEED = 11
#: Labelled findings of the kinds that the broad candidates add; the first kinds have those of FINDINGS.
MORE, FIRST_KINDS = 4200, 12

# Dictionary words and neighbouring words (fixed values).
DICTIONARY = "the|and|for|with|from|this|that|usr|lib|bin|share|local|home|src|test|data|file|name|page|image|index|html|http|https|www|com|org|net|version|release|python|packages|dist|example|quick|brown|fox|lazy|dog|report|draft|final|year|month"
KEY_WORDS = rf"{KEYS}[^\n]{{0,20}}$"
ID_WORDS = r"(?i)(commit|sha|md5|hash|checksum|digest|uuid|guid|request|revision|version|order|invoice|isbn|page|phone|card|account)[^\n]{0,10}$"

#: Starts of keys that name their issuer.
PREFIXES = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^(gh[opsur]_|github_pat_|glpat-|sk_live_|rk_live_|xox[abprs]-|AIza|SG\.)|^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.|^-----BEGIN "

FEATURES = ("length", "transitions", "digits", "uppers", "hexadecimal", "dictionary", "slashes", "joints", "key_word", "id_word", "assigned", "prefix", "vowels", "specials", "spaces", "distinct", "cases", "ended", "prose", "call", "address", "stated", "blank")


def features(text: Column, before: Column, behind: Column) -> dict[str, Column]:
    n = F.length(text)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    covered = n - F.length(F.regexp_replace(F.lower(text), DICTIONARY, ""))
    return {
        "length": n.cast("double"),
        "transitions": F.regexp_count(text, F.lit(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]")) / n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "hexadecimal": text.rlike("^[0-9a-f]+$").cast("double"),
        "dictionary": covered / n,
        "slashes": F.regexp_count(text, F.lit("[/.]")).cast("double"),
        "joints": F.regexp_count(text, F.lit("[-_]")).cast("double"),
        "key_word": before.rlike(KEY_WORDS).cast("double"),
        "id_word": before.rlike(ID_WORDS).cast("double"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("double"),
        "prefix": text.rlike(PREFIXES).cast("double"),
        "vowels": share("[AEIOUaeiou]"),
        "specials": share(r"[^A-Za-z0-9+/_.\s-]"),
        "spaces": share(" "),
        "distinct": (F.size(F.array_distinct(F.split(text, ""))) / n),
        "cases": F.regexp_count(text, F.lit("[A-Z](?![a-z])|(?<=[a-z])[A-Z]")) / n,
        "ended": behind.rlike("^[\"';,)\\]}]*[ \\t]*(\\n|$)").cast("double"),
        "call": text.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*\(").cast("double"),
        "blank": text.rlike(r"^[<{$%\[(]|^(.)\1*$").cast("double"),  # a place to fill in, or one character over and over
        "address": (before.rlike(r"://[^\s:/@]*:$") & behind.startswith("@")).cast("double"),
        "stated": before.rlike(r" is:? $").cast("double"),
        "prose": F.regexp_count(behind, F.lit("(?<![^ ])[a-z]{2,}(?![^ .,])")).cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS, more: int = MORE) -> DataFrame:
    """(text, before, behind, secret): every known kind of secret and of look-alike in equal parts."""
    rows = spark.range(n + more).select("id", F.sha2(F.col("id").cast("string"), 512).alias("h"))
    raw = F.translate(F.base64(F.unhex("h")), "+/=", "xyz")
    word = F.element_at(F.array(*[F.lit(w) for w in ("report", "the", "for", "page", "with", "and")]), (F.col("id") % 6 + 1).cast("int"))
    size = lambda low, high: (F.pmod(F.xxhash64("id"), F.lit(high - low + 1)) + low).cast("int")
    pick = lambda seed, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(of))) + 1).cast("int"))
    syllable = lambda seed: pick(seed, "on", "er", "tion", "ver", "schaft", "lich", "ment", "able", "que", "con", "di", "ra")
    long_word = F.concat(*[syllable(i) for i in range(7)])
    noun = lambda seed: pick(seed, "user", "page", "report", "login", "access", "name", "token", "field", "order", "value")
    plain = lambda seed: pick(seed, "horse", "river", "table", "copper", "window", "orange", "silent", "garden", "yellow", "battery")
    letters = F.translate(raw, "0123456789xyz", "kQzWpLmRtBvXc")
    assigned = pick(90, 'password="', "password: ", "pwd=", "secret = '", 'api_key: "', "auth_token=", '"passwd": "')
    kinds = [
        (F.substring("h", 1, 40), F.lit('token = "'), 1),
        (F.substr(raw, F.lit(1), size(24, 44)), F.lit("api_key: "), 1),
        (F.substr(raw, F.lit(5), size(16, 28)), F.lit("password="), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(raw, 3, 16))), F.lit("aws access key "), 1),
        (F.concat(F.lit("ghp_"), F.substring(raw, 2, 36)), F.concat(word, F.lit(" ")), 1),
        (F.substring(raw, 1, 64), F.lit("Authorization: Bearer "), 1),
        (F.substring("h", 7, 40), F.lit("commit "), 0),
        (F.substr(F.col("h"), F.lit(1), F.when(F.col("id") % 2 == 0, 32).otherwise(64)), F.lit("checksum sha256: "), 0),
        (F.concat(F.lit("/usr/lib/python3."), (F.col("id") % 14).cast("string"), F.lit("/dist-packages/"), word, F.lit("/index.html")), F.lit("see "), 0),
        (F.concat(word, F.lit("-quick-brown-"), (F.col("id") % 50).cast("string"), F.lit("-fox-"), word), F.concat(word, F.lit(" ")), 0),
        (F.substr(F.translate("h", "abcdef", "123456"), F.lit(1), size(16, 24)), F.concat(F.element_at(F.array(F.lit("order "), F.lit("card "), F.lit("the ")), (F.col("id") % 3 + 1).cast("int"))), 0),
        (F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)), F.lit("request id "), 0),
        # short passwords, letters alone, other characters, passphrases
        (F.substr(raw, F.lit(9), size(8, 15)), assigned, 1),
        (F.concat(F.initcap(F.translate(plain(1), "oaei", "0431")), pick(2, "", "!", "#", "$"), F.translate(F.substring("h", 1, 4), "abcdef", "123456")), assigned, 1),
        (F.concat(plain(38), F.translate(F.substring("h", 1, 1), "abcdef", "123456"), F.left(plain(39), F.lit(4)), F.translate(F.substring("h", 2, 2), "abcdef", "123456")), assigned, 1),
        (F.substr(letters, F.lit(3), size(12, 44)), assigned, 1),
        (F.concat(F.substr(letters, F.lit(3), size(8, 20)), F.translate(F.substring("h", 1, 1), "abcdef", "123456"), F.substr(letters, F.lit(30), size(8, 20))), assigned, 1),
        (F.substr(F.translate("h", "0123456789abcdef", "qwrtpsdfghjklzxv"), F.lit(1), size(16, 32)), assigned, 1),
        (F.concat(F.substring(raw, 1, 3), pick(3, "!", "@", "$", "%"), F.substring(raw, 4, 4), pick(4, "!", "@", "$", "%", "^"), F.substring(raw, 9, 3)), assigned, 1),
        (F.concat(F.substr(letters, F.lit(3), size(8, 20)), F.upper(pick(40, "example", "test", "page", "key", "user")), F.substr(raw, F.lit(30), size(4, 20))), assigned, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 3, 16))), F.concat(word, F.lit(" ")), 1),
        (F.concat_ws(" ", plain(5), plain(6), plain(7), plain(8)), pick(9, 'passphrase: "', 'password = "', "secret='"), 1),
        (F.concat_ws("-", plain(5), plain(6), plain(7), plain(8)), assigned, 1),
        # long words, names in code, paths, plain words and sentences after a key word, places to fill in
        (F.when(F.col("id") % 2 == 0, long_word).otherwise(F.initcap(long_word)), F.concat(word, F.lit(" ")), 0),
        (F.concat(pick(11, "get", "set", "is", "load", "find"), F.initcap(noun(12)), F.initcap(noun(13)), F.initcap(noun(14))), pick(15, "call ", "token = ", "the ", "password: ", "auth="), 0),
        (F.concat(F.lit("/"), plain(16), F.lit("/"), noun(17), F.lit("/"), plain(18), pick(19, "", "/index.html", ".txt")), pick(20, "see ", "private key: ", "in "), 0),
        (F.concat(noun(22), pick(21, "_", "."), noun(23), pick(21, "_", "."), plain(24)), pick(25, "the ", "token = ", "secret: ", "auth="), 0),
        (F.substr(F.concat(syllable(26), long_word), F.lit(1), size(8, 15)), pick(27, "password: ", "secret: ", "Author: ", "signature: ", "private: "), 0),
        (F.concat(F.initcap(plain(28)), F.lit(" the "), noun(29), F.lit(" for the "), noun(30), pick(31, ".", ".", "!")), pick(32, 'password: "', 'secret = "', 'token: "'), 0),
        (pick(33, "xxxxxxxxxxxx", "************", "<your-token-here", "${API_TOKEN", "${{ secrets.TOKEN", "os.environ[TOKEN", "get_token(user", "config.auth.token", "process.env.SECRET", "YOUR_API_KEY_HERE", "undefined", "required", "changeme"), assigned, 0),
        (F.concat_ws("_", F.upper(noun(34)), F.upper(noun(35)), F.upper(noun(36)), F.lit("KEY")), pick(37, "export ", "set ", "the "), 0),
    ]
    verb = lambda seed: pick(seed, "get", "load", "read", "fetch", "make", "find")
    shown = pick(41, "required", "invalid", "generated", "unavailable", "authenticated", "incorrect", "mandatory", "encrypted", "case-sensitive", "case_sensitive", "transmitted", "important", "something", "stored_hashed")
    states = pick(42, "the password is ", "The token is ", "your passphrase is ", "secret is: ", "my password is ")
    address = F.concat(pick(43, "postgres", "mysql", "https", "redis", "amqp"), F.lit("://"), pick(44, "admin", "root", "app", "", "deploy"), F.lit(":"))
    kinds += [
        # tokens of three parts, key blocks, passwords in addresses and in sentences
        (F.concat(F.lit("eyJ"), F.substring(raw, 1, 17), F.lit(".eyJ"), F.substr(raw, F.lit(20), size(10, 30)), F.lit("."), F.substr(raw, F.lit(41), size(18, 44))), F.concat(word, F.lit(" ")), 1),
        (F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), F.substring(raw, 1, 64), F.lit("\n"), F.substr(raw, F.lit(9), size(8, 64)), F.lit("\n-----END PRIVATE KEY-----")), F.lit("\n"), 1),
        (F.substr(raw, F.lit(7), size(6, 24)), address, 1),
        (F.concat(plain(45), pick(46, "", "!", "_", "7", "42"), plain(47)), address, 1),
        (F.concat(plain(48), plain(49), pick(50, "", "staple", "moon", "1", "99")), states, 1),
        (F.substr(raw, F.lit(11), size(8, 20)), states, 1),
        # words that a sentence says of a password, calls of functions, tokens cut in three without a head
        (shown, states, 0),
        (shown, states, 0),
        (F.concat(verb(51), F.lit("_"), noun(52), pick(53, "_from_", "_for_", "_by_"), noun(54), pick(55, "(", "()", "(self")), assigned, 0),
        (F.concat(noun(56), F.lit("."), verb(57), F.initcap(noun(58)), F.initcap(noun(59)), pick(60, "(", "()", "(request")), assigned, 0),
        (F.concat(pick(65, "<your-", "<", "${", "{{ ", "$", "%(", "["), noun(66), pick(67, "_", "-", "."), plain(68)), assigned, 0),
        (F.rpad(pick(69, "*", "x", "X", ".", "0", "A", "-"), size(8, 40), pick(69, "*", "x", "X", ".", "0", "A", "-")), F.when(F.col("id") % 2 == 0, assigned).otherwise(F.concat(word, F.lit(" "))), 0),
        (F.concat_ws("-", noun(70), plain(71), pick(72, "text", "label", "field", "form")), pick(73, 'aria-label="', 'for="', 'id="', 'class="'), 0),
        (F.upper(F.substr(F.concat(syllable(74), long_word), F.lit(1), size(16, 30))), F.concat(word, F.lit(" ")), 0),
        (F.concat(F.lit("com."), noun(61), F.lit("."), plain(62), F.lit("."), F.initcap(noun(63)), F.initcap(plain(64))), F.concat(word, F.lit(" ")), 0),
    ]
    turn = F.floor(F.col("id") / 6)
    kind = F.when(F.col("id") < n, turn % FIRST_KINDS).otherwise(FIRST_KINDS + turn % (len(kinds) - FIRST_KINDS)).cast("int")
    chosen = F.element_at(F.array(*[F.struct(t.alias("text"), b.alias("before"), F.lit(s).alias("secret")) for t, b, s in kinds]), kind + 1)
    closing = F.when(F.col("f.before").rlike("://[^/]*:$"), "@db.internal").when(F.col("f.before").endswith('"'), '"').when(F.col("f.before").endswith("'"), "'").otherwise("")
    follows = F.concat(closing, pick(91, "\n", "", ";\n", ",\n", " and the rest", " was found in it", ", then more text", " # see the notes", ")\n"))
    return rows.select("id", chosen.alias("f")).select("f.text", "f.before", follows.alias("behind"), "f.secret")


def _grow(rows: list[tuple[list[float], int]], rng: random.Random, levels: int):
    """A tree of (feature, threshold, low, high) nodes and shares of secrets as leaves."""
    share = sum(y for _, y in rows) / len(rows)
    if levels == 0 or len(rows) < 2 * LEAF or share in (0.0, 1.0):
        return share
    best = None
    for f in rng.sample(range(len(FEATURES)), 4):
        values = sorted({x[f] for x, _ in rows})
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
        for cut in cuts[:: max(1, len(cuts) // 24)]:
            low = [y for x, y in rows if x[f] <= cut]
            n, k = len(low), sum(low)
            m, j = len(rows) - n, sum(y for _, y in rows) - k
            if min(n, m) < LEAF:
                continue
            impurity = k * (n - k) / n + j * (m - j) / m
            if best is None or impurity < best[0]:
                best = (impurity, f, cut)
    if best is None:
        return share
    _, f, cut = best
    return f, cut, _grow([r for r in rows if r[0][f] <= cut], rng, levels - 1), _grow([r for r in rows if r[0][f] > cut], rng, levels - 1)


_forests: dict[tuple, list] = {}


def forest(spark: SparkSession, n: int = FINDINGS, trees: int = TREES, levels: int = LEVELS, seed: int = SEED) -> list:
    """Trees grown on bootstrap samples of the labelled findings, four features a split."""
    key = (n, trees, levels, seed)
    if key not in _forests:
        found = labelled_findings(spark, n)
        numbers = found.select(*[c.alias(name) for name, c in features(F.col("text"), F.col("before"), F.col("behind")).items()], "secret")
        rows = [([r[name] for name in FEATURES], r["secret"]) for r in numbers.collect()]  # n rows
        rng = random.Random(seed)
        _forests[key] = [_grow(rng.choices(rows, k=len(rows)), rng, levels) for _ in range(trees)]
    return _forests[key]


def _tree_column(node, at: dict[str, Column]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    f, cut, low, high = node
    return F.when(at[FEATURES[f]] <= cut, _tree_column(low, at)).otherwise(_tree_column(high, at))


def scan(docs: DataFrame, trees: list | None = None) -> DataFrame:
    """One row a document: `row`, all its columns, `text`, `pieces`, the text around candidates, and `findings` array<struct<text, p, secret>>."""
    trees = trees or forest(docs.sparkSession)
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
    out = docs.select(row, F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    out = out.withColumn("pieces", F.when(F.size("found") > 0, F.split("text", CANDIDATE)))
    # a struct of numbers for each candidate first, so that each is computed once
    found, pieces = F.col("found"), F.col("pieces")
    near = F.transform(
        found,
        lambda t, i: F.struct(
            t.alias("text"),
            F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(pieces, i)), F.lit(BEFORE)).alias("before"),  # the candidate before may hold the key word
            F.left(F.get(pieces, i + 1), F.lit(BEHIND)).alias("behind"),
        ),
    )
    out = out.withColumn("near", near)
    out = out.withColumn("numbers", F.transform("near", lambda s: F.struct(*[c.alias(n) for n, c in features(s["text"], s["before"], s["behind"]).items()])))
    chance = lambda s: reduce(lambda a, b: a + b, [_tree_column(t, {n: s[n] for n in FEATURES}) for t in trees]) / len(trees)
    out = out.withColumn("p", F.transform("numbers", chance))
    p = F.col("p")
    findings = F.transform("found", lambda t, i: F.struct(t.alias("text"), F.get(p, i).alias("p"), (F.get(p, i) >= 0.5).alias("secret")))
    return out.select("row", "text", "pieces", findings.alias("findings"))


def _redacted(found: DataFrame) -> DataFrame:
    """Adds `clean`, the text with marks for its secrets."""
    marks = F.transform("findings", lambda s: F.when(s["secret"], F.lit(MARK)).otherwise(s["text"]))
    whole = F.array_join(F.zip_with("pieces", marks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return found.withColumn("clean", F.when(F.size("findings") > 0, whole).otherwise(F.col("text")))


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets_sha256 (secrets in order, joined by newlines), redacted_sha256."""
    found = _redacted(scan(documents.select("doc_id", "text")))
    secrets = F.transform(F.filter("findings", lambda s: s["secret"]), lambda s: s["text"])
    return found.select(
        "row.doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"),
        F.sha2(F.array_join(secrets, "\n"), 256).alias("secrets_sha256"), F.sha2("clean", 256).alias("redacted_sha256"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each secret in their text replaced by a mark."""
    found = _redacted(scan(docs))
    clean = F.when(F.col("row.text").isNotNull(), F.col("clean"))
    return found.select(*[(clean if c.lower() == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
