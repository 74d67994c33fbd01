"""Operator 9: personal data by weak supervision.

One pass over the texts finds the base spans (fixed patterns) and wider candidates: numbers, token-like
strings, spelt-out addresses, handles, names after a cue. Labelers vote on each candidate: its format,
its check digits or ranges, a gazetteer, the words before it, and its surroundings. The counts of all
vote patterns of the corpus (a table whose size is bounded by the number of patterns) go through
expectation-maximisation for the labelers' reliabilities by kind; the posteriors are the soft labels
of the final span classifier, a logistic regression over votes, kind and shape. Candidates that the
classifier takes are added where they overlap no base span.

Edge cases: NULL and empty texts have no spans; ids may be NULL or repeat; other columns are ignored;
an empty table gives an empty result. Positions count code points, ends are exclusive. Very long texts are
read whole, in time linear in their length, whatever runs of characters they hold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, saved, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "handle", "name")
LABELERS = ("format", "check", "gazetteer", "context", "surroundings")
#: The classifier's fit holds so many distinct patterns as a matrix at once.
FIT_BLOCK = 20_000

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the leftmost match starts at a run's first digit, and no run gives back a digit: each is read four times at most
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().-]{5,24}[0-9]")
#: A spelt address from its "at" on; the part before is the run that ends there.
_SPELT = re.compile(r" ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}", re.I)
_KEYED = re.compile(r"\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[:=]\s*[\"']?([^\s\"',;]{6,})", re.I)
_TOKENISH = re.compile(r"[A-Za-z0-9_-]{20,}+")
_HANDLE = re.compile(r"(?<![\w.@])@[A-Za-z_][A-Za-z0-9_]{2,30}\b(?!\.?[A-Za-z0-9-]*\.)")
_NAMED = re.compile(r"\b(?:[Mm]y name is|[Nn]ame:|[Cc]ontact:|[Ss]igned,|Mr\.|Mrs\.|Ms\.|Dr\.|Herr|Frau|[Mm]ein Name ist|Monsieur|Madame|[Jj]e m'appelle|Señor|Señora|Sr\.|Sra\.|[Mm]e llamo) ([A-ZÄÖÜÉÈÁÍÓÚÑÇ][a-zäöüßéèêáíóúñç]+(?: [A-ZÄÖÜÉÈÁÍÓÚÑÇ][a-zäöüßéèêáíóúñç]+){0,2})")
_NAME_CUES = ("ame is ", "ame: ", "ontact: ", "igned, ", "Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Herr ", "Frau ", "ame ist ", "onsieur ", "adame ", "appelle ", "eñor ", "eñora ", "Sr. ", "Sra. ", "llamo ")

# Words that stand before personal data in English, German, French and Spanish, by kind, and words
# that speak against it.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "reach", "kontakt", "schreiben", "adresse", "courriel", "écrire", "contactez", "correo", "contacto", "escribir"),
    "ip": ("ip", "address", "host", "server", "client", "login", "adresse", "rechner", "serveur", "hôte", "servidor", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "pan", "karte", "kreditkarte", "zahlung", "carte", "paiement", "bancaire", "tarjeta", "pago"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "contact", "telefon", "anrufen", "handy", "nummer", "téléphone", "appeler", "portable", "teléfono", "llamar", "móvil"),
    "secret": ("token", "secret", "key", "password", "auth", "bearer", "api", "passwort", "kennwort", "schlüssel", "geheim", "clé", "passe", "jeton", "contraseña", "clave"),
    "handle": ("follow", "twitter", "instagram", "telegram", "handle", "dm", "folge", "folgen", "suivez", "sigue", "síguenos", "mastodon"),
    "name": ("name", "contact", "signed", "mr", "mrs", "ms", "dr", "herr", "frau", "gezeichnet", "monsieur", "madame", "signé", "nom", "señor", "señora", "firmado", "nombre"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "section", "page", "chapter", "figure", "release", "sha", "commit", "seite", "kapitel", "abschnitt", "rechnung", "bestellung", "chapitre", "facture", "commande", "página", "capítulo", "factura", "pedido")
# Top-level domains, issuer prefixes, calling codes, key names and given names.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "io", "info", "biz", "dev", "app", "me", "eu", "de", "fr", "es", "uk", "it", "nl", "be", "ch", "at", "pl", "pt", "se", "no", "dk", "fi", "ie", "cz", "gr", "hu", "ro",
    "ru", "ua", "tr", "us", "ca", "mx", "br", "ar", "cl", "co", "pe", "au", "nz", "jp", "cn", "kr", "in", "id", "sg", "hk", "tw", "th", "vn", "ph", "za", "eg", "ma", "ng", "ke", "il", "ae", "sa",
)
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "36", "38", "39", "6011", "62", "64", "65", "35")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "85", "88", "96", "97", "99")
KEY_NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth", "passwort", "kennwort", "contraseña", "clave")
GIVEN = (
    "james", "mary", "john", "anna", "peter", "maria", "paul", "laura", "david", "sarah", "thomas", "julia", "michael", "emma", "robert", "linda", "william", "susan", "richard", "karen", "joseph", "nancy", "charles", "lisa", "daniel", "betty", "matthew", "helen", "anthony", "sandra", "mark", "ashley", "george", "emily", "andrew", "olivia",
    "hans", "klaus", "jürgen", "wolfgang", "stefan", "andreas", "matthias", "sabine", "petra", "monika", "ursula", "heike", "katrin", "ingrid", "birgit", "lukas", "leon", "jonas", "felix", "johanna", "lena",
    "jean", "pierre", "michel", "philippe", "alain", "nicolas", "françois", "jacques", "antoine", "luc", "marie", "nathalie", "isabelle", "sylvie", "catherine", "françoise", "camille", "chloé", "julie", "sophie", "claire",
    "jose", "josé", "carlos", "juan", "luis", "miguel", "javier", "francisco", "antonio", "manuel", "pedro", "alejandro", "diego", "carmen", "ana", "isabel", "pilar", "dolores", "lucia", "lucía", "elena", "rosa", "cristina", "marta",
)
_CONTEXT, _AGAINST, _DOMAINS, _GIVEN = {k: frozenset(v) for k, v in CONTEXT.items()}, frozenset(AGAINST), frozenset(DOMAINS), frozenset(GIVEN)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: the part before an @ is the whole run of its characters."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def spelt(text: str) -> list[tuple[int, int]]:
    """Addresses with a spelt-out "at" and "dot", leftmost and without overlaps."""
    found, end, m = [], 0, _SPELT.search(text)
    while m:
        start, after = m.start(), m.start() + 1
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = after = m.end()
            found.append((start, end))
        m = _SPELT.search(text, after)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _has_digit(text):
        if text.count(".") > 2:
            for m in _IP.finditer(text):
                if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                    found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


_DIGIT = re.compile("[0-9]")


def _has_digit(text: str) -> bool:
    return _DIGIT.search(text) is not None


def candidates(text: str, base: list) -> list[tuple[int, int, int]]:
    """(start, kind's number, end): the base spans and wider guesses; overlaps are settled at the end."""
    found = {(a, k, b) for a, k, b in base}
    if _has_digit(text):
        for m in _NUMBER.finditer(text):
            n = len(_NOT_DIGIT.sub("", m.group()))
            if 7 <= n <= 19:
                kind = 2 if n >= 13 and m.group()[0] not in "+(" else 1 if m.group().count(".") == 3 and n <= 12 else 3
                found.add((m.start(), kind, m.end()))
        for m in _TOKENISH.finditer(text):
            if _DIGIT.search(m.group()):
                found.add((m.start(), 4, m.end()))
    if "=" in text or ":" in text:
        for m in _KEYED.finditer(text):
            found.add((m.start(1), 4, m.end(1)))
    if "@" in text:
        for m in _HANDLE.finditer(text):
            found.add((m.start(), 5, m.end()))
    low = text.lower()
    if any(x in low for x in ("(at)", "[at]", " at ")) and any(x in low for x in ("(dot)", "[dot]", " dot ")):
        found.update((a, 0, b) for a, b in spelt(text))
    if any(cue in text for cue in _NAME_CUES):
        for m in _NAMED.finditer(text):
            found.add((m.start(1), 6, m.end(1)))
    return sorted(found)


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def votes(text: str, start: int, kind: int, end: int, is_base: bool) -> tuple[str, str]:
    """(votes, shape): a letter for each labeler, y, n or - (abstains); bounded shape features."""
    span, name = text[start:end], KINDS[kind]
    digits = _NOT_DIGIT.sub("", span)
    before = re.findall(r"[\w-]+", text[max(0, start - 48) : start].lower())[-5:]
    bits = entropy(span)
    form = {"secret": bool(_KEYED.search(text[max(0, start - 24) : end])), "handle": True, "name": " " in span}.get(name, is_base)
    if name == "card":
        check = luhn(digits) and len(digits) >= 14
    elif name == "ip":
        check = all(len(x) < 4 and int(x) < 256 for x in re.findall("[0-9]+", span))
    elif name == "phone":
        check = 10 <= len(digits) <= 15
    elif name == "secret":
        check = bits > 3.0 and bool(digits)
    elif name == "email":
        check = "@" in span or None
    else:
        check = None
    low = span.lower()
    known = {
        "email": low.rsplit(".", 1)[-1] in _DOMAINS,
        "card": digits.startswith(ISSUERS),
        "phone": span[0] == "+" and digits.startswith(CALLING) or None,
        "secret": any(k in KEY_NAMES for k in before[-2:]) or None,
        "name": low.split(" ")[0] in _GIVEN or None,
    }.get(name)
    near = set(before)
    context = True if near & _CONTEXT[name] else False if near & _AGAINST else None
    left, right = text[start - 1 : start], text[end : end + 1]
    around = not (left.isalnum() or left in ("#", "%", "$", "/") or right.isalnum() or right in ("%", "/"))
    shape = f"{name}|{min(9, (end - start) // 4)}|{0 if not span else 4 * len(digits) // len(span)}|{min(4, int(bits))}"
    return "".join("-" if v is None else "y" if v else "n" for v in (form, check, known, context, around)), shape


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Expectation-maximisation (a labeler's chances of each vote by truth and kind) over counted vote
    patterns (kind, votes, n); gives each pattern's chance of being personal data."""
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        n = np.array([c for _, c in rows], float)
        seen = np.array([["yn-".index(c) for c in v] for v, _ in rows])
        p = np.clip(((seen == 0).sum(1) + 0.5) / ((seen < 2).sum(1) + 1.0), 0.05, 0.95)  # first: the majority
        for _ in range(rounds):
            prior = np.clip((p @ n) / n.sum(), 0.01, 0.99)
            log_odds = np.full(len(rows), math.log(prior / (1 - prior)))
            for j in range(seen.shape[1]):
                chance = []
                for truth in (p, 1 - p):
                    # pseudo-counts: a labeler is more often right than wrong
                    right, wrong = (2.0, 1.0) if truth is p else (1.0, 2.0)
                    counts = np.bincount(seen[:, j], truth * n, 3) + np.array([right, wrong, 1.0])
                    chance.append(counts / counts.sum())
                log_odds += np.log(chance[0][seen[:, j]] / chance[1][seen[:, j]])
            p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        out |= {(kind, v): float(x) for (v, _), x in zip(rows, p, strict=True)}
    return out


def features(vote: str, shape: str) -> list[str]:
    name, length, digits, bits = shape.split("|")
    return ["1", name, *(f"{name}:{lab}:{v}" for lab, v in zip(LABELERS, vote, strict=True)), f"len{length}", f"dig{digits}", f"bits{bits}"]


def fit_classifier(patterns: list[tuple[str, str, float, int]], rounds: int = 60) -> dict[str, float]:
    """Logistic regression over (votes, shape, soft label, n) by Newton steps with a ridge of 1."""
    index: dict[str, int] = {}
    rows = [[index.setdefault(f, len(index)) for f in features(v, s)] for v, s, _, _ in patterns]
    at = np.array(rows)
    y, n, w = np.array([p for *_, p, _ in patterns]), np.array([float(c) for *_, c in patterns]), np.zeros(len(index))
    n = n / max(1.0, n.sum() / 1e5)
    for _ in range(rounds):
        grad, curve = -w, np.eye(len(w))
        for a in range(0, len(rows), FIT_BLOCK):
            part = slice(a, a + FIT_BLOCK)
            x = np.zeros((len(at[part]), len(index)))
            x[np.arange(len(x))[:, None], at[part]] = 1
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = grad + x.T @ (n[part] * (y[part] - q))
            curve = curve + (x * (n[part] * q * (1 - q))[:, None]).T @ x
        step = np.linalg.solve(curve, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max(initial=0) < 1e-6:
            break
    return {f: float(w[i]) for f, i in index.items()}


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, start array<int>, kind array<int>, stop array<int>, votes array<string>, shape array<string>"
_FOUND_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")), ("base", pa.string()), *((c, pa.list_(pa.int32())) for c in ("start", "kind", "stop")), *((c, pa.list_(pa.string())) for c in ("votes", "shape"))])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def find_candidates(docs: DataFrame) -> DataFrame:
    """A row per document: counts and text form of its base spans, and its candidates with votes."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in _FOUND_ARROW]
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                cand = candidates(text, base) if text else []
                known = set(base)
                voted = [votes(text, *c, c in known) for c in cand]
                n = Counter(k for _, k, _ in base)
                row = (n[0], n[1], n[2], n[3], joined(base), [c[0] for c in cand], [c[1] for c in cand], [c[2] for c in cand], [v for v, _ in voted], [s for _, s in voted])
                for col, value in zip(cols[1:], row, strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols[1:], list(_FOUND_ARROW)[1:], strict=True))], schema=_FOUND_ARROW)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), _FOUND)


def pii_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base ones and added ones), n_added, n_all and
    has_pii (any span)."""
    spark = docs.sparkSession
    found = saved(find_candidates(docs), "pii-candidates")
    pattern = F.explode(F.arrays_zip("votes", "shape")).alias("c")
    counted = found.select(pattern).groupBy("c.votes", "c.shape").count()
    # at most kinds x 3^labelers vote patterns, times bounded shapes
    by_vote = counted.groupBy(F.substring_index("shape", "|", 1).alias("kind"), "votes").agg(F.sum("count").alias("n")).collect()
    posterior = reliabilities([(r["kind"], r["votes"], r["n"]) for r in by_vote])
    top = counted.orderBy(F.desc("count"), "votes", "shape").collect()
    weights = fit_classifier([(r["votes"], r["shape"], posterior[r["shape"].split("|")[0], r["votes"]], r["count"]) for r in top]) if top else {}
    sent, cut = spark.sparkContext.broadcast(weights), math.log(threshold / (1 - threshold))

    def decide(batches):
        w, known = sent.value, {}
        for batch in batches:
            sha, spans, added = [], [], []
            for base, *cand in zip(*(batch.column(k).to_pylist() for k in range(5, 11)), strict=True):
                first = [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
                more, taken = [], sorted((a, b) for a, _, b in first)
                for a, k, b, v, s in zip(*cand, strict=True):
                    if (v, s) not in known:
                        known[v, s] = sum(w.get(f, 0.0) for f in features(v, s)) >= cut
                    if known[v, s]:
                        more.append((a, k, b))
                # leftmost first, then the longest; none may overlap what is taken
                new, at, end = [], 0, 0
                for a, k, b in sorted(more, key=lambda x: (x[0], -x[2], x[1])):
                    while at < len(taken) and taken[at][1] <= a:
                        at += 1
                    if a >= end and all(b <= x or y <= a for x, y in taken[at : at + 8]):
                        new.append((a, k, b))
                        end = b
                sha.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(joined(sorted([*first, *new])))
                added.append(len(new))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    decided = found.mapInArrow(lean(decide), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    n_all = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_added")
    return decided.withColumn("n_all", n_all).withColumn("has_pii", F.col("n_all") > 0)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))
