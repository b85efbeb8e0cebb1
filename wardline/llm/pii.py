"""Surrogates for personal data: keyed, of the same type, script, gender and format.

Detection is one pattern over the whole text (e-mail and network addresses, phone, card, account and
social numbers, secrets, and people's names after a title or with a known given name).  A surrogate is
a function of a secret key, the type and the entity's normal form, so the same entity reads the same
everywhere, however it is spelled, and a surname that a text has in a name is replaced wherever else it
stands alone in that text (coreference), and:

* digits stay digits in the same places (country codes and a card's first digit stay, a card that
  passes the Luhn check still passes), letters stay in their alphabet and case: a keyed permutation of all
  strings of that format, a character after the other, shifted by what stands before it and then by what
  stands after it, so different entities of one format never read alike; letters of alphabets not listed
  become Latin ones;
* a given name becomes another one of the same gender and script, by a keyed cycle through the list,
  which is one to one; surnames and host names are composed of syllables of their script; titles stay.

Collision checks: over all distinct entities of the table, a surrogate that equals another entity's
surrogate, or any entity that really occurs, is drawn again (the smallest entity keeps it).  What is composed
gets longer with the draws, so no table exhausts it.  A format so crowded that ``ROUNDS`` draws do not free it of
what really occurs goes by the permutation alone: distinct, though a surrogate may be someone's number.
The redrawn ones are few; they reach the texts as one table of at most ``MAP_ENTITIES`` (checked), and else by a join.

Only DataFrame functions.  Defined cases: null text stays null, empty text stays empty; a text without
entities is returned as it is, byte for byte; repeated rows are rewritten each, alike; null doc_id is
kept; an empty table gives an empty result; extra columns pass through untouched.
"""

from __future__ import annotations

import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, narrowed

#: The key of tests and of sessions that set none: pass ``key``, or set SETTING, to one that is kept secret.
KEY = "wardline-surrogates-1"
SETTING = "wardline.surrogates.key"
#: Redrawn entities that may be sent to every task (some megabytes); beyond that they are joined by document.
MAP_ENTITIES = 100_000
#: Redrawn entities of one small map, about.
MAP_PART = 8
#: Rounds after which a format counts as crowded.
ROUNDS = 24
#: Longest string that the permutation writes; longer ones are drawn, and do not meet by chance.
PERMUTED = 64
#: Tasks that share the rows of one text in the join.
SALTS = 32

# Given names by gender and script, and titles by gender.
GIVEN = {
    "f_latin": "Alice Anna Barbara Carmen Catherine Charlotte Claire Elena Elizabeth Emily Emma Greta Hannah Heidi Helena Ingrid Isabelle Jennifer Julia Karen Laura Linda Lucia Maria Marie Martina Mary Michelle Monica Nicole Olivia Patricia Paula Rachel Sarah Sofia Sophie Susan Ursula Victoria".split(),
    "m_latin": "Adam Albert Alexander Andrew Anthony Antonio Benjamin Carlos Charles Christopher Daniel David Diego Edward Felix Francisco George Hans Henry Jacques James Javier John Joseph Juan Karl Kevin Klaus Louis Manuel Mark Michael Nicholas Oliver Patrick Paul Peter Pierre Robert Thomas William Wolfgang".split(),
    "f_cyrillic": "Александра Алина Анастасия Анна Виктория Галина Дарья Екатерина Елена Ирина Ксения Людмила Мария Наталья Ольга Полина Светлана Татьяна Юлия".split(),
    "m_cyrillic": "Александр Алексей Андрей Борис Виктор Владимир Григорий Дмитрий Евгений Иван Игорь Константин Михаил Николай Олег Павел Сергей Фёдор Юрий".split(),
    "f_greek": "Αικατερίνη Άννα Βασιλική Ελένη Ειρήνη Ιωάννα Μαρία Παρασκευή Σοφία Χριστίνα".split(),
    "m_greek": "Αλέξανδρος Ανδρέας Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Μιχαήλ Νικόλαος Παναγιώτης Χρήστος".split(),
}
TITLES = "Mrs Ms Miss Madame Mme Mlle Frau Señora Sra Señorita Mr Sir Monsieur Herr Señor Sr Dr Prof Professor".split()
SYLLABLES = {
    "latin": "ba be bo da del den for gar hal han jor kel lan lin mar mel mon nor par per ral ren ros sal sel tan tor val ver win zel".split(),
    "cyrillic": "ба ве во гор дан дол жар зин кал кор лан лев мар мел нов пал пет рад рос сев сол тар тол фед хар чер шап яр".split(),
    "greek": "βα γα γε δα δη ζα θε κα κο λα λε μα με νι ξα πα πε ρο σα σο τα τσι φα χα".split(),
}

_W = r"\p{L}\p{N}"
_NAME = r"\p{Lu}[\p{L}'’-]*\p{Ll}"
_GIVEN_ANY = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n)))
_TITLE = "|".join(sorted(TITLES, key=lambda t: (-len(t), t)))

#: (type, pattern of the entity, what it begins with, what else must not stand before, what must not follow).
#: Before any entity stands no letter or digit; earlier types win.
ENTITIES = [
    ("email", rf"[{_W}._%+-]{{1,64}}+@[{_W}-]{{1,63}}(?:\.[{_W}-]{{1,63}}){{0,6}}\.\p{{L}}{{2,24}}", "", r"[._%+-]", rf"[{_W}]"),
    ("secret", r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,251}|sk-[A-Za-z0-9_-]{16,200}|xox[abprs]-[A-Za-z0-9-]{10,200}|eyJ[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{4,1000})", "[Agsxe]", r"[_-]", rf"[{_W}]"),
    ("hex", r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})", "[0-9A-Fa-f]{4}", "", rf"[{_W}]"),
    ("ipv6", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,30}[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}", "[0-9A-Fa-f]{1,4}:", ":", rf"[{_W}:]"),
    ("mac", r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}", "[0-9A-Fa-f]{2}[:-]", "[:-]", rf"[{_W}:]"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "[A-Z]{2}[0-9]", "", rf"[{_W}]"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}", "[0-9+(]", "[+.]", rf"[{_W}]"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]", "[.-]", rf"[{_W}-]"),
    ("card", r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}", "[0-9]", "[.]", rf"[{_W}]"),
    ("ipv4", r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}", "[0-9]", "[.]", rf"[{_W}]|\.[0-9]"),
    ("name", rf"(?:(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?:{_GIVEN_ANY}) {_NAME})", rf"\p{{Lu}}[\p{{L}}'’-]*\.? \p{{Lu}}", "", rf"[{_W}]"),
]
PATTERN = rf"(?<![{_W}])(?:" + "|".join(
    (f"(?={begins})" if begins else "") + (f"(?<!{before})" if before else "") + f"(?:{p})(?!{after})" for _, p, begins, before, after in ENTITIES
) + ")"


#: What a match of PATTERN that has no digit, no @ and no secret's head holds: a title or given name before a capital
#: letter, wherever PATTERN lets an entity begin (so inside hyphened words too), or hexadecimal letters.
_LETTERS_ONLY = [
    rf"(?<![{_W}])(?=\p{{Lu}}[\p{{L}}'’-]*\.? \p{{Lu}})(?:{_TITLE}|{_GIVEN_ANY})\.? \p{{Lu}}",
    ":[A-Fa-f]{1,4}:|-[A-Fa-f]{2}-[A-Fa-f]{2}-|[a-f]{32}|[A-F]{32}",
]


def may_hold(text: Column) -> Column:
    """False only for texts without any match of PATTERN, whose parts imply these.  Cheaper than the pattern, which
    then need not run."""
    names, letters = _LETTERS_ONLY
    return text.rlike(r"[0-9@]") | text.rlike(r"sk-|xox|eyJ|AKIA|gh[pousr]_") | text.rlike(names) | text.rlike(letters)


def let(over, /, **values: Column) -> Column:
    """``over`` of a struct of ``values``, each computed once however often it is used."""
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(one, over), F.lit(0))


def hits(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(may_hold(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def kind_of(hit: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, p, *_ in reversed(ENTITIES):
        out = F.when(hit.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def normal(kind: Column, hit: Column) -> Column:
    """What all spellings of an entity share."""
    country = F.when(hit.startswith("+"), F.regexp_extract(hit, r"^\+([0-9]{1,3}?)(?:[ .(-]|(?=[0-9]{9,11}$))", 1)).otherwise(F.lit(""))
    phone = F.concat(country, F.lit("|"), F.substr(_digits(hit), F.length(country) + 1))
    return (
        F.when(kind.isin("email", "mac", "ipv6"), F.lower(hit))
        .when(kind == "phone", phone)
        .when(kind.isin("card", "ssn"), _digits(hit))
        .when(kind == "iban", F.replace(hit, F.lit(" "), F.lit("")))
        .when(kind == "ipv4", F.array_join(F.transform(F.split(hit, r"\."), lambda x: x.cast("int").cast("string")), "."))
        .otherwise(hit)
    )


def subkey(key: str, use: str) -> str:
    return hmac.new(key.encode(), use.encode(), "sha256").hexdigest()


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 keyed hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(subkey(key, "stream")), kind, attempt.cast("string"), norm).cast("binary"), 512)


def _number(h: Column, at: Column) -> Column:
    """The byte at ``at`` (from 0, around after 64) of the stream."""
    return F.conv(F.substr(h, (at % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


#: First and last characters of stretches of letters (or digits) that replace one another.
STRETCHES = (
    "09 az AZ àö øÿ ÀÖ ØÞ "  # digits, Latin
    "αω ΑΡ ΣΩ άώ ая АЯ ѐџ ЀЏ "  # Greek, Cyrillic
    "աֆ ԱՖ აჺ את ءغ في अह กฮ ぁゖ ァヺ 가힣 一鿿"  # Armenian, Georgian, Hebrew, Arabic, Devanagari, Thai, kana, Hangul, Han
).split()
#: The same where letters are hexadecimal digits.
HEXADECIMAL = ("09", "AF", "af")


def _bounds(stretches: tuple[str, ...] | list[str], end: int) -> Column:
    """The first (0) or last (1) code points of the stretches in ascending order; a constant that the optimizer folds."""
    return F.split(F.lit(",".join(str(ord(s[end])) for s in sorted(stretches))), ",").cast("array<int>")


def _shifted(c: Column, n: Column, hexadecimal: Column) -> Column:
    """The character ``n`` places further on in its stretch, around at its end; a letter of none becomes a Latin one; others stay."""

    def ends(end: int) -> Column:
        return F.when(hexadecimal, _bounds(HEXADECIMAL, end)).otherwise(_bounds(STRETCHES, end))

    def of(x: Column) -> Column:
        at = F.size(F.filter(x["los"], lambda lo: lo <= x["code"])) - 1
        lo, hi = F.get(x["los"], at), F.get(ends(1), at)
        return let(placed, c=x["c"], code=x["code"], n=x["n"], lo=lo, hi=hi)

    def placed(x: Column) -> Column:
        return let(shown, c=x["c"], n=x["n"], to=F.when(x["code"] <= x["hi"], x["lo"] + F.pmod(x["code"] - x["lo"] + x["n"], x["hi"] - x["lo"] + 1)).cast("int"))

    def shown(x: Column) -> Column:
        letter = F.char((F.lit(97) + F.pmod(x["n"], F.lit(26))).cast("int"))
        return (
            F.when(x["to"] < 128, F.char(x["to"])).when(x["to"].isNotNull(), F.decode(F.unhex(F.lpad(F.hex(x["to"]), 8, "0")), "UTF-32"))
            .when(x["c"].rlike(r"^\p{L}"), letter).otherwise(x["c"])
        )

    return let(of, c=c, code=F.ascii(c), n=n, los=ends(0))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != F.lit(""))


def _keyed_number(*parts: Column) -> Column:
    return F.conv(F.left(F.sha2(F.concat(*parts).cast("binary"), 256), F.lit(14)), 16, 10).cast("bigint")


def permuted(text: Column, seed: Column, hexadecimal: Column) -> Column:
    """``text`` written anew in its own format; one to one for each seed, up to ``PERMUTED`` characters and but for odd letters.

    Each character is shifted by a keyed hash of those before it, then each by one of those after it: reading the result
    from its end, and then from its beginning, tells every shift.  A longer text is shifted by one keyed stream.
    """

    def forth(x: Column) -> Column:
        drawn = lambda i: (_number(x["h"], i) * 256 + _number(x["h"], i * 7 + 3)).cast("bigint")
        turn = lambda i: F.when(x["h"].isNull(), _keyed_number(x["seed"], F.lit(">"), F.left(x["t"], i))).otherwise(drawn(i))
        made = F.transform(_characters(x["t"]), lambda c, i: _shifted(c, turn(i), x["hexadecimal"]))
        return let(back, t=F.array_join(made, ""), seed=x["seed"], hexadecimal=x["hexadecimal"], long=x["h"].isNotNull())

    def back(x: Column) -> Column:
        turn = lambda i: _keyed_number(x["seed"], F.lit("<"), F.substr(x["t"], i + 2, F.length(x["t"])))
        made = F.transform(_characters(x["t"]), lambda c, i: _shifted(c, turn(i), x["hexadecimal"]))
        return F.when(x["long"], x["t"]).otherwise(F.array_join(made, ""))

    h = lambda x: F.when(F.length(x["t"]) > PERMUTED, F.sha2(F.concat(x["seed"], x["t"]).cast("binary"), 512))
    return let(lambda x: let(forth, t=x["t"], seed=x["seed"], hexadecimal=x["hexadecimal"], h=h(x)), t=text, seed=seed, hexadecimal=hexadecimal)


def _luhn_digit(body: Column) -> Column:
    """The check digit after ``body``."""
    n = F.length(body)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(body, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _composed(script: str, h: Column, count: Column) -> Column:
    parts = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    pick = lambda i: F.get(parts, (_number(h, 2 * i) * 256 + _number(h, 2 * i + 1)) % len(SYLLABLES[script]))
    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), pick), "")


def _more(attempt: Column, least: int) -> Column:
    """Syllables of a draw: one more with every second draw, as far as the stream tells them."""
    return F.least(F.lit(least) + F.floor(attempt / 2).cast("int"), F.lit(32))


def _surname(word: Column, h: Column, attempt: Column) -> Column:
    script = _script(word)
    composed = lambda kind: F.initcap(_composed(kind, h, _more(attempt, 4)))
    made = F.when(script == "cyrillic", composed("cyrillic")).when(script == "greek", composed("greek")).otherwise(composed("latin"))
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(made)).otherwise(made)


def given_names(key: str) -> dict[str, str]:
    """Each listed given name and the one that stands for it: the next in an order that the key decides, around at the end."""
    out = {}
    for group, names in GIVEN.items():
        order = sorted(names, key=lambda n: subkey(key, f"{group}|{n}"))
        out.update(zip(order, [*order[1:], order[0]], strict=True))
    return out


def _given(word: Column, key: str) -> Column:
    """Another given name of the same gender and script; null for other words.  One to one."""
    cycle = given_names(key)
    listed, to = F.array(*[F.lit(n) for n in cycle]), F.array(*[F.lit(n) for n in cycle.values()])
    return F.get(to, F.array_position(listed, word).cast("int") - 1)


def _known(word: Column) -> Column:
    return word.isin(*[n for names in GIVEN.values() for n in names])


def surrogate(kind: Column, norm: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate's normal form of a unit (an entity, a host, or for names a surname); an e-mail's keeps the host."""

    def of(u: Column) -> Column:
        kind, norm = u["kind"], u["norm"]
        seed = F.concat_ws("|", F.lit(subkey(key, "permutation")), kind, u["attempt"].cast("string"), F.when(kind == "email", F.substring_index(norm, "@", -1)).otherwise(F.lit("")))
        # what stays before and what is written anew
        head = (
            F.when(kind == "secret", F.regexp_extract(norm, r"^(?:AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ)", 0))
            .when(kind == "iban", F.left(norm, F.lit(2))).when(kind == "phone", F.concat(F.substring_index(norm, "|", 1), F.lit("|")))
            .when(kind == "card", F.left(norm, F.lit(1))).otherwise(F.lit(""))
        )
        h = _stream(key, kind, norm, u["attempt"])
        return let(split, kind=kind, norm=norm, attempt=u["attempt"], h=h, seed=seed, head=head)

    def split(u: Column) -> Column:
        kind, norm = u["kind"], u["norm"]
        rest = F.substr(norm, F.length(u["head"]) + 1)
        body = (
            F.when(kind == "email", F.substring_index(norm, "@", 1)).when(kind == "card", F.left(rest, F.length(rest) - 1))
            .when(kind.isin("host", "name", "ipv4"), F.lit("")).otherwise(rest)
        )
        made = F.concat(u["head"], permuted(body, u["seed"], kind.isin("hex", "ipv6", "mac")))
        return let(_surrogate, kind=kind, norm=norm, attempt=u["attempt"], h=u["h"], seed=u["seed"], made=made)

    return let(of, kind=kind, norm=norm, attempt=attempt)


def _check_digit(x: Column) -> Column:
    """It holds if the card's held, and does not if that did not."""

    def of(y: Column) -> Column:
        off = F.when(y["off"] == 0, F.lit(0)).otherwise(F.pmod(y["off"] - 1 + y["turn"], F.lit(9)) + 1)
        return F.pmod(_luhn_digit(y["made"]).cast("int") + off, F.lit(10)).cast("int").cast("string")

    off = F.pmod(F.right(x["norm"], F.lit(1)).cast("int") - _luhn_digit(F.left(x["norm"], F.length(x["norm"]) - 1)).cast("int"), F.lit(10))
    return let(of, made=x["made"], off=off, turn=_keyed_number(x["seed"], x["made"]))


def _octets(norm: Column, seed: Column) -> Column:
    """Each octet shifted by a keyed hash of those before it, then by those after it."""

    def turned(x: Column, after: bool) -> Column:
        rest = lambda i: F.slice(x["o"], i + 2, F.lit(4)) if after else F.slice(x["o"], F.lit(1), i)
        number = lambda i: _keyed_number(x["seed"], F.lit("<" if after else ">"), F.array_join(rest(i), "."))
        return F.transform(x["o"], lambda o, i: F.pmod(o.cast("int") + number(i), F.lit(256)).cast("string"))

    second = lambda x: F.array_join(turned(x, True), ".")
    return let(lambda x: let(second, o=turned(x, False), seed=x["seed"]), o=F.split(norm, r"\."), seed=seed)


def _surrogate(x: Column) -> Column:
    kind, norm, attempt, h = (x[c] for c in ("kind", "norm", "attempt", "h"))
    tld = F.substring_index(norm, ".", -1)
    # what is written in letters of no listed alphabet may meet: then it gets longer
    longer = F.when(attempt > 0, F.translate(F.left(h, attempt), "0123456789", "ghijklmnop")).otherwise(F.lit(""))
    return (
        F.when(kind == "email", F.concat(x["made"], longer, F.lit("@"), F.substring_index(norm, "@", -1)))
        .when(kind == "host", F.concat(_composed("latin", h, _more(attempt, 3)), F.lit(".example."), F.when(tld.isin("com", "org", "net"), tld).otherwise("com")))
        .when(kind == "card", F.concat(x["made"], _check_digit(x)))
        .when(kind == "ipv4", _octets(norm, x["seed"]))
        .when(kind == "name", _surname(norm, h, attempt))
        .otherwise(x["made"])
    )


def _is_title(word: Column) -> Column:
    return F.regexp_replace(word, r"\.$", "").isin(*TITLES)


def units(hit: Column) -> Column:
    """(kind, norm) of what must keep apart: the entity, an address and its host, or the surnames of a name."""

    def unit(kind: Column, norm: Column) -> Column:
        return F.struct(kind.alias("kind"), norm.alias("norm"))

    def of(x: Column) -> Column:
        words = F.filter(F.split(x["hit"], " "), lambda w: ~_is_title(w) & ~_known(w))
        names = F.transform(words, lambda w: unit(F.lit("name"), w))
        one = unit(x["kind"], x["norm"])
        host = unit(F.lit("host"), F.substring_index(x["norm"], "@", -1))
        return F.when(x["kind"] == "name", names).when(x["kind"] == "email", F.array(one, host)).otherwise(F.array(one))

    return let(lambda x: let(of, hit=x["hit"], kind=x["kind"], norm=normal(x["kind"], x["hit"])), hit=hit, kind=kind_of(hit))


def rewritten(hit: Column, attempt_of, key: str = KEY) -> Column:
    """text: the hit's surrogate in the hit's own format; names: its surnames and what stands for them."""

    def one(u: Column) -> Column:
        return F.struct(u["norm"].alias("w"), surrogate(u["kind"], u["norm"], attempt_of(u["kind"], u["norm"]), key).alias("to"))

    def placed(hit: Column, made: Column) -> Column:
        """Its letters and digits, one after the other, where the hit has letters and digits."""

        def place(c: Column, i: Column) -> Column:
            before = F.length(F.regexp_replace(F.left(hit, i), "[^0-9A-Za-z]", ""))
            return F.when(c.rlike("[0-9A-Za-z]"), F.substr(made, before + 1, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(_characters(hit), place), "")

    def of(x: Column) -> Column:
        return let(shown, hit=x["hit"], kind=x["kind"], made=F.transform(x["units"], one))

    def shown(x: Column) -> Column:
        first = F.get(x["made"], F.lit(0))["to"]
        word = lambda w: F.coalesce(_given(w, key), F.get(F.filter(x["made"], lambda m: m["w"] == w), F.lit(0))["to"], w)
        name = F.array_join(F.transform(F.split(x["hit"], " "), lambda w: F.when(_is_title(w), w).otherwise(word(w))), " ")
        address = F.concat(F.substring_index(first, "@", 1), F.lit("@"), F.get(x["made"], F.lit(1))["to"])
        plain = F.when(x["kind"] == "email", address).otherwise(F.replace(first, F.lit("|"), F.lit("")))
        text = (
            F.when(x["kind"] == "name", name).when(x["kind"].isin("phone", "card", "ssn", "iban"), let(lambda y: placed(y["hit"], y["plain"]), hit=x["hit"], plain=plain))
            .when((F.upper(x["hit"]) == x["hit"]) & x["kind"].isin("email", "mac", "ipv6"), F.upper(plain)).otherwise(plain)
        )
        names = F.filter(x["made"], lambda m: (x["kind"] == "name") & (F.length(m["w"]) > 1))
        return F.struct(text.alias("text"), names.alias("names"))

    return let(lambda x: let(of, hit=x["hit"], kind=x["kind"], units=units(x["hit"])), hit=hit, kind=kind_of(hit))


#: What the permutation writes; the other kinds are composed, or get longer, with each draw.
FORMATS = ("secret", "hex", "ipv6", "mac", "iban", "phone", "ssn", "card", "ipv4")


def _format(norm: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(norm, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")


def redrawn(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, attempt) of the units whose first surrogate collides; ``found`` are the distinct units."""
    tried = found.withColumn("attempt", F.lit(0))
    crowded = None
    for turn in range(1000):
        made = tried.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key))
        made = cut(made)
        # the unit that came to a surrogate first keeps it: fewest attempts, then the smallest
        keeper = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "norm")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        twice = keeper.where(F.col("n") > 1).select("kind", "made", F.col("keeper.norm").alias("keeper"))
        clash = made.join(twice, ["kind", "made"]).where(F.col("norm") != F.col("keeper")).select("kind", "norm")
        # an address's host changes anyway
        real = made.select("kind", F.col("norm").alias("made")).where(F.col("kind") != "email")
        real = made.join(real, ["kind", "made"], "left_semi").select("kind", "norm")
        if crowded is not None:  # there the permutation alone decides
            real = real.withColumn("f", _format(F.col("norm"))).join(crowded, ["kind", "f"], "left_anti").drop("f")
        bad = cut(clash.unionByName(real).distinct())
        if bad.isEmpty():
            return cut(tried.where(F.col("attempt") > 0))
        if turn >= ROUNDS and not (full := bad.where(F.col("kind").isin(*FORMATS))).isEmpty():
            more = full.select("kind", _format(F.col("norm")).alias("f")).distinct()
            crowded = cut(more if crowded is None else crowded.unionByName(more).distinct())
            reset = made.drop("made").withColumn("f", _format(F.col("norm"))).join(crowded.withColumn("back", F.lit(True)), ["kind", "f"], "left")
            tried = cut(reset.select("kind", "norm", F.when(F.col("back"), F.lit(0)).otherwise(F.col("attempt")).alias("attempt")))
            bad = bad.withColumn("f", _format(F.col("norm"))).join(crowded, ["kind", "f"], "left_anti").drop("f")
        else:
            tried = made.drop("made")
        tried = tried.join(bad.withColumn("again", F.lit(1)), ["kind", "norm"], "left")
        tried = tried.select("kind", "norm", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise RuntimeError("surrogates still collide")


def pseudonymised(documents: DataFrame, text: str = "text", map_entities: int = MAP_ENTITIES, key: str = KEY) -> DataFrame:
    """``documents`` with ``text`` rewritten, and n_entities."""
    found = documents.select(F.explode(hits(F.col(text))).alias("hit")).distinct()
    found = found.select(F.inline(units(F.col("hit")))).distinct()
    again = redrawn(cut(found), key)
    n = again.count()
    name = lambda kind, norm: F.concat_ws("|", kind, norm)
    docs = documents.withColumn("_hits", hits(F.col(text)))
    entry = F.struct(name(F.col("kind"), F.col("norm")).alias("key"), F.col("attempt").alias("value"))
    if n == 0:
        attempt_of = lambda kind, norm: F.lit(0)
    elif n <= map_entities:  # checked: some megabytes; small maps by a hash, as a map is searched from its beginning
        parts = -(-n // MAP_PART)
        part = lambda k: F.pmod(F.xxhash64(k), F.lit(parts)).cast("int")
        small = again.select(entry.alias("e")).groupBy(part(F.col("e.key")).alias("p")).agg(F.map_from_entries(F.collect_list("e")).alias("m"))
        every = spark_range(documents, parts).join(small, "p", "left").agg(F.array_sort(F.collect_list(F.struct("p", F.struct(F.col("m").alias("m")).alias("s"))), _by_part).alias("l"))
        docs = docs.crossJoin(F.broadcast(every.select(F.transform("l", lambda x: x["s"]["m"]).alias("_again"))))
        attempt_of = lambda kind, norm: F.coalesce(F.try_element_at(F.get(F.col("_again"), part(name(kind, norm))), name(kind, norm)), F.lit(0))
    else:
        # only texts with entities meet the redrawn ones, a text's rows in SALTS shares
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
        docs = docs.withColumn("_key", F.when(F.size("_hits") > 0, F.xxhash64(text)).otherwise(F.xxhash64(F.monotonically_increasing_id()))).withColumn("_salt", salt)
        at = docs.where(F.size("_hits") > 0).select("_key", F.explode("_hits").alias("hit")).distinct()
        at = at.select("_key", F.inline(units(F.col("hit")))).distinct().join(again, ["kind", "norm"])
        maps = at.groupBy("_key").agg(F.map_from_entries(F.collect_set(entry)).alias("_again"))
        maps = maps.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        docs = docs.join(maps, ["_key", "_salt"], "left").drop("_key", "_salt")
        attempt_of = lambda kind, norm: F.coalesce(F.try_element_at(F.col("_again"), name(kind, norm)), F.lit(0))
    some = F.size("_hits") > 0
    docs = docs.withColumn("_parts", F.when(some, F.split(F.col(text), PATTERN, -1)))
    docs = docs.withColumn("_made", F.when(some, F.transform("_hits", lambda h: rewritten(h, attempt_of, key))))
    # surnames that stand alone elsewhere in the text
    docs = docs.withColumn("_names", F.array_distinct(F.flatten(F.transform("_made", lambda m: m["names"]))))
    whole = lambda w: F.concat(F.lit(rf"(?<![{_W}])\Q"), w, F.lit(rf"\E(?![{_W}])"))
    swapped = lambda t: F.aggregate("_names", t, lambda a, x: F.when(F.contains(a, x["w"]), F.regexp_replace(a, whole(x["w"]), x["to"])).otherwise(a))
    rest = F.when(F.size("_names") > 0, F.transform("_parts", swapped)).otherwise(F.col("_parts"))
    docs = docs.withColumn("_parts", rest)
    pieces = F.transform("_made", lambda m, i: F.concat(F.get(F.col("_parts"), i), m["text"]))
    new = F.concat(F.array_join(pieces, ""), F.get(F.col("_parts"), F.size("_hits")))
    names = [c for c in documents.columns]
    out = [F.when(some, new).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in names]
    return docs.select(*out, F.size("_hits").cast("bigint").alias("n_entities"))


def spark_range(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("p"))


def _by_part(a: Column, b: Column) -> Column:
    return a["p"] - b["p"]


def surrogates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, text (rewritten), n_entities, changed for every row of ``documents``."""
    docs = narrowed(documents, doc_id="bigint", text="string")
    out = pseudonymised(docs, key=spark.conf.get(SETTING, KEY))
    return out.select("doc_id", "text", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), (F.col("n_entities") > 0).alias("changed"))
