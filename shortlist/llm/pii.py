"""Replacement of personal data by keyed surrogates.

Finds e-mail addresses, phone numbers, payment card numbers, IBANs, national
numbers, IPv4 and IPv6 addresses and person names (after a form of address, or a
known given name before another name). A name runs on over initials, particles
and further capitalised words, and wherever else the document has one of its
words, that is replaced too. Every entity has a canonical form (lower
case, or digits only), and its surrogate is a function of the secret key, the
type and that form alone: the same entity gets the same surrogate in every
document and in every way of writing it. A surrogate keeps the type and the
format: length, separators, case, the alphabet's script, the country code and
the domain's ending; IP octets and groups stay valid; given names keep their gender, and
a surname keeps its own with every given name before it.

Distinctness: all distinct entities of the corpus are collected (one row each,
pre-aggregated in each task). Where two get the same surrogate, or a surrogate
is itself an entity of the corpus, the later ones draw again with the next
number, until none is left. From draw ``GROWS_AT`` on each draw makes names a
syllable and addresses and numbers a character longer, so that the space grows
and no corpus exhausts it; IPv4 addresses alone stay within 254^4 forms. Only those exceptions (entity, number) are joined
back, and only to the texts that hold one; all other texts are rewritten in
place, without a shuffle.

Defined results: a null text stays null, an empty one empty; texts without
entities are unchanged; nulls in other columns, repeated rows and null or
repeated ids change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import col
from shortlist.session import cut_lineage

KEY = "surrogate-key-1"
#: The draws that keep the length; each one from here on makes the surrogate longer.
GROWS_AT = 8
#: Exceptions up to which they are broadcast (about 100 bytes each).
BROADCAST_EXCEPTIONS = 500_000

# Forms of address and given names by gender.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Lady", "Dame", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita",
                 "Signora", "Sig.ra", "Госпожа", "Κυρία")
MALE_TITLES = ("Mr", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Sig", "Господин", "Κύριος")
TITLES = ("Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Mx", "Rev", "Доктор", "Профессор")
FEMALE_NAMES = (
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emma",
    "Anna", "Maria", "Laura", "Sophie", "Claire", "Camille", "Marie", "Julie", "Petra", "Sabine", "Ursula", "Heike",
    "Carmen", "Lucía", "Isabel", "Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна",
    "Olivia", "Ava", "Isabella", "Mia", "Amelia", "Harper", "Evelyn", "Abigail", "Emily", "Ella", "Ann", "Anne", "Alice",
    "Amanda", "Amy", "Andrea", "Angela", "Ashley", "Betty", "Brenda", "Carol", "Caroline", "Catherine", "Charlotte",
    "Christina", "Christine", "Cynthia", "Deborah", "Diana", "Diane", "Donna", "Dorothy", "Eleanor", "Ellen", "Emilia",
    "Eva", "Frances", "Gloria", "Hannah", "Heather", "Helen", "Jane", "Janet", "Joan", "Joyce", "Judith", "Julia",
    "Katherine", "Kathleen", "Kelly", "Kimberly", "Lauren", "Lisa", "Lucy", "Margaret", "Martha", "Megan", "Melissa",
    "Michelle", "Nancy", "Natalie", "Nicole", "Pamela", "Rachel", "Rebecca", "Ruth", "Samantha", "Sandra", "Sharon",
    "Sofia", "Stephanie", "Teresa", "Theresa", "Victoria", "Virginia", "Zoe", "Brigitte", "Claudia", "Gisela", "Helga",
    "Ingrid", "Jana", "Katharina", "Katrin", "Lena", "Monika", "Renate", "Silke", "Simone", "Stefanie", "Susanne", "Ute",
    "Amélie", "Aurélie", "Chantal", "Céline", "Élodie", "Françoise", "Hélène", "Isabelle", "Manon", "Mathilde", "Monique",
    "Nathalie", "Sylvie", "Valérie", "Ana", "Beatriz", "Cristina", "Elena", "Inés", "Mercedes", "Pilar", "Rosa", "Giulia",
    "Francesca", "Chiara", "Екатерина", "Ирина", "Светлана", "Людмила", "Галина", "Юлия", "Дарья", "Ελένη", "Κατερίνα")
MALE_NAMES = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel",
    "Peter", "Paul", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Pierre", "Jean", "Jacques", "Luc", "José",
    "Juan", "Carlos", "Miguel", "Иван", "Сергей", "Дмитрий", "Алексей", "Андрей", "Николай",
    "Liam", "Noah", "Oliver", "Elijah", "Lucas", "Henry", "Benjamin", "Ethan", "Jacob", "Adam", "Alan", "Albert",
    "Alexander", "Andrew", "Anthony", "Arthur", "Brandon", "Brian", "Bruce", "Carl", "Christopher", "Dennis", "Donald",
    "Douglas", "Edward", "Eric", "Eugene", "Frank", "Gary", "George", "Gerald", "Gregory", "Harold", "Harry", "Howard",
    "Ian", "Jack", "Jason", "Jeffrey", "Jeremy", "Jerry", "Jonathan", "Joshua", "Justin", "Keith", "Kenneth", "Kevin",
    "Larry", "Lawrence", "Leo", "Louis", "Luke", "Martin", "Matthew", "Nathan", "Nicholas", "Patrick", "Philip", "Ralph",
    "Raymond", "Roger", "Ronald", "Roy", "Russell", "Ryan", "Samuel", "Scott", "Sean", "Simon", "Stephen", "Steven",
    "Timothy", "Tyler", "Vincent", "Walter", "Wayne", "Andreas", "Bernd", "Christian", "Dieter", "Felix", "Florian",
    "Friedrich", "Fritz", "Günter", "Heinrich", "Helmut", "Horst", "Jan", "Jens", "Johannes", "Jörg", "Karl", "Lukas",
    "Manfred", "Markus", "Matthias", "Maximilian", "Ludwig", "Otto", "Rainer", "Ralf", "Sebastian", "Uwe", "Werner",
    "Alain", "André", "Antoine", "Bernard", "Christophe", "Étienne", "François", "Frédéric", "Guillaume", "Henri",
    "Julien", "Laurent", "Marc", "Mathieu", "Nicolas", "Olivier", "Philippe", "Alejandro", "Antonio", "Diego",
    "Fernando", "Francisco", "Javier", "Jorge", "Luis", "Manuel", "Pablo", "Pedro", "Rafael", "Sergio", "Giovanni",
    "Giuseppe", "Marco", "Александр", "Владимир", "Михаил", "Павел", "Олег", "Юрий", "Γιώργος", "Νίκος")

# A possessive 's does not belong to a name.
_WORD = r"\p{Lu}(?:\p{L}|['’](?!s(?!\p{L}))(?=\p{L}))++"
_NAME = rf"{_WORD}(?:-{_WORD})*"
_INITIAL = r"\p{Lu}(?:\.(?:-?\p{Lu}\.)*|(?![\p{L}'’.]))"
PARTICLES = ("von", "van", "vom", "zu", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "bin",
             "ibn", "al", "el", "ter", "ten")
# What a name runs on over; particles only before a further name.
_MORE = rf"(?:\x20{_INITIAL}|(?:\x20(?:{'|'.join(PARTICLES)}))*\x20{_NAME}(?![\p{{L}}\p{{N}}]))"
_TITLES = "|".join(t.replace(".", r"\.") for t in FEMALE_TITLES + MALE_TITLES + TITLES)
_GIVEN = "|".join(FEMALE_NAMES + MALE_NAMES)
EMAIL = (r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62}+\.)+\p{L}{2,24}"
         r"(?![\p{L}\p{N}])")
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
PHONE = (r"(?<![\d.])(?:\+\d{1,3}[ .-]?|1[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
         r"|(?<!\d)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
         r"|(?<![\d.-])00[1-9]\d{0,2}(?:[ .-]?\d{2,4}){2,5}(?![\d-])"
         r"|(?<![\d.-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
         # National numbers with a trunk zero, and without any separator.
         r"|(?<![\d.-])0[1-9]\d{0,3}(?:[ /-]\d{6,8}|[ /-]\d{3,4}[ -]\d{3,5})(?![\d-])"
         r"|(?<![\d.-])0[1-9](?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4})(?![\d-])"
         r"|(?<![\p{L}\p{N}.-])(?:1?[2-9]\d{9}|0[1-9]\d{8,10})(?![\p{L}\p{N}-]|\.\d)")
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
IP6 = (rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*\d)(?!(?:[0-9A-Fa-f]*:){{9}})(?:{_HEX}(?::{_HEX})*)?::"
       rf"(?:{_HEX}(?::{_HEX})*)?)(?![\p{{L}}\p{{N}}:])")
CARD = r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])"
PERSON = (rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:{_TITLES})\.?\x20)+(?:{_INITIAL}\x20)*{_NAME}|(?:{_GIVEN})(?![\p{{L}}\p{{N}}])"
          rf"(?:\x20{_INITIAL})*(?:\x20(?:{'|'.join(PARTICLES)}))*\x20{_NAME})"
          rf"(?![\p{{L}}\p{{N}}]){_MORE}*+")
# What a match begins with is looked at first, as most positions fail there.
NO_EMAIL = rf"(?=\p{{Lu}})(?:{IBAN}|{PERSON})|(?=[+(\d])(?:{IP}|{SSN}|{PHONE}|{CARD})|(?=[0-9A-Fa-f]{{0,4}}:){IP6}"
ENTITY = f"{EMAIL}|{NO_EMAIL}"

LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщыэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
#: Syllables of surrogate names by script.
SYLLABLES = {
    "latin": ["bra", "cor", "del", "fen", "gar", "hol", "jan", "kel", "lor", "mar", "nev", "pol", "ran", "sel", "tor",
              "ver", "wil", "zan", "bel", "dan"],
    "cyrillic": ["бра", "вол", "гор", "дан", "жур", "зор", "кол", "лев", "мар", "нов", "пет", "рад", "сел", "тур",
                 "фед", "хар", "чер", "шум", "бел", "мил"],
    "greek": ["αλ", "βα", "γερ", "δημ", "ζαν", "θεο", "καρ", "λαμ", "μαρ", "νικ", "παν", "ραλ", "σταυ", "τρι", "φιλ",
              "χαρ", "κων", "πετ", "σωτ", "βλα"],
}
#: Endings of surrogate names: given names by gender, surnames of any.
ENDINGS = {
    ("latin", "f"): ["a", "ia", "ina", "elle"], ("latin", "m"): ["o", "us", "er", "an"],
    ("latin", "n"): ["y", "is", "en", "el"], ("latin", "s"): ["son", "mann", "ett", "ley"],
    ("cyrillic", "f"): ["а", "ия", "ина", "ьяна"], ("cyrillic", "m"): ["ий", "ей", "ан", "слав"],
    ("cyrillic", "n"): ["ка", "ша", "ня", "ся"], ("cyrillic", "s"): ["енко", "ук", "ич", "ян"],
    ("greek", "f"): ["α", "ια", "ινα", "ουλα"], ("greek", "m"): ["ος", "ης", "ας", "ιος"],
    ("greek", "n"): ["ι", "ω", "ις", "υ"], ("greek", "s"): ["ιδης", "ακης", "οπουλος", "ου"],
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once; else each character's
    expression would compute it anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(e: Column) -> Column:
    """The type of an entity's text. Person names are split into their words
    before, see ``units``."""
    return (F.when(F.instr(e, "@") > 0, "email").when(e.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
            .when(e.rlike(f"^(?:{IP})$"), "ip").when(e.rlike(f"^(?:{IP6})$"), "ip6").when(e.rlike(f"^(?:{SSN})$"), "ssn")
            .when(e.rlike(f"^(?:{PHONE})$"), "phone").when(e.rlike(f"^(?:{CARD})$"), "card").otherwise("person"))


def script_of(word: Column) -> Column:
    return (F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek")
            .otherwise("latin"))


def is_title(word: Column) -> Column:
    return F.rtrim(word, F.lit(".")).isin(*FEMALE_TITLES, *MALE_TITLES, *TITLES)


def units(e: Column) -> Column:
    """An entity as array<struct<text, kind>>: itself, or the words of a
    person's name. Kinds of words: title, particle, initial, given-f, given-m,
    given-n, surname (the last word that is a name)."""
    words = F.split(e, " ")
    # The gender by the first title or given name that tells one.
    first = F.get(F.filter(F.transform(words, lambda w: F.rtrim(w, F.lit("."))), lambda w: w.isin(
        *FEMALE_TITLES, *FEMALE_NAMES, *MALE_TITLES, *MALE_NAMES)), F.lit(0))
    gender = (F.when(first.isin(*FEMALE_TITLES, *FEMALE_NAMES), "f").when(first.isin(*MALE_TITLES, *MALE_NAMES), "m")
              .otherwise("n"))
    initial = lambda w: w.rlike(f"^{_INITIAL}$")
    # Titles stand in front only; a name may be one later ("John Lord").
    titles = let(F.array_position(F.transform(words, is_title), F.lit(False)), lambda n: F.when(n == 0, 0).otherwise(n - 1))
    last = F.size(words) - F.array_position(F.transform(F.reverse(words), lambda w: ~initial(w)), F.lit(True))

    def word(w: Column, i: Column, n: Column, end: Column, g: Column) -> Column:
        kind = (F.when(i < n, "title").when(w.isin(*PARTICLES), "particle").when(initial(w), "initial")
                .when(i == end, "surname").otherwise(F.concat(F.lit("given-"), g)))
        return F.struct(w.alias("text"), kind.alias("kind"))

    people = let(F.struct(titles.alias("n"), last.alias("end"), gender.alias("g")), lambda s: F.transform(
        words, lambda w, i: word(w, i, s["n"], s["end"], s["g"])))
    kind = kind_of(e)
    return F.when(kind == "person", people).otherwise(
        F.array(F.struct(e.alias("text"), kind.alias("kind"))))


#: A trunk zero, and country codes of one and two digits; all others have three.
COUNTRY = r"^0|^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def canonical(text: Column, kind: Column) -> Column:
    """What identifies the entity, itself a way of writing it: digits for
    numbers, after a + if a country code is written (as +, 00 or the 1 before
    ten digits), else lower case."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    phone = (F.when(F.startswith(text, F.lit("+")), F.concat(F.lit("+"), digits))
             .when(digits.rlike("^00[1-9]"), F.concat(F.lit("+"), F.substring(digits, F.lit(3), F.length(digits))))
             .when(digits.rlike("^1[0-9]{10}$"), F.concat(F.lit("+"), digits)).otherwise(digits))
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(
        kind == "iban", F.regexp_replace(text, " ", "")).when(kind == "ip6", _full_ip6(F.lower(text))).otherwise(
        F.lower(text))


def _groups(part: Column) -> Column:
    return F.filter(F.split(part, ":"), lambda g: g != "")


def _full_ip6(text: Column) -> Column:
    """All eight groups of four digits, with :: written out."""
    halves = F.split(text, "::")
    full = let(F.struct(_groups(F.get(halves, F.lit(0))).alias("a"), F.coalesce(
        _groups(F.get(halves, F.lit(1))), F.array().cast("array<string>")).alias("b")), lambda h: F.concat(
            h["a"], F.array_repeat(F.lit("0"), 8 - F.size(h["a"]) - F.size(h["b"])), h["b"]))
    return F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ":")


def _ip6(text: Column, canon: Column, draw: Column, seed: Column) -> Column:
    """Groups that are not zero replaced by their place in the full address,
    so that :: stays; from draw ``GROWS_AT`` on all eight."""
    group = lambda i: F.lower(F.hex(F.lit(4096) + _number(seed, i, 61440)))
    all_groups = F.transform(F.split(canon, ":"), lambda g, i: F.when((g == "0000") & (_longer(draw) == 0), "0").otherwise(group(i)))
    left = F.size(_groups(F.substring_index(text, "::", 1)))
    right = F.size(_groups(F.substring_index(text, "::", -1)))
    short = let(all_groups, lambda g: F.when((F.instr(text, "::") == 0) | (_longer(draw) > 0), F.array_join(g, ":")).otherwise(
        F.concat(F.array_join(F.slice(g, F.lit(1), left), ":"), F.lit("::"), F.array_join(F.slice(g, 9 - right, right), ":"))))
    return F.when(text == F.upper(text), F.upper(short)).otherwise(short)


def seed_of(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """The key stream's seed. Phone numbers with and without country code are
    told apart by their canonical form, all genders of a name by their type."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, draw.cast("string")), 256)


def _number(seed: Column, i: Column, most: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(most)).cast("int")


def _pick(letters: str, seed: Column, i: Column) -> Column:
    return F.substring(F.lit(letters), _number(seed, i, len(letters)) + 1, F.lit(1))


def _longer(draw: Column) -> Column:
    """By how many characters or syllables a draw's surrogate is longer."""
    return F.greatest(draw - (GROWS_AT - 1), F.lit(0))


def _more(letters: str, seed: Column, draw: Column) -> Column:
    """The characters by which a draw's surrogate is longer."""
    n = _longer(draw)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(letters, seed, -i)), "")
                  ).otherwise("")


def _same_format(text: Column, seed: Column) -> Column:
    """Each digit and letter replaced by one of its kind, script and case; spaces
    do not count, so that every way of writing an IBAN gives the same ones."""
    def one(c: Column, i: Column) -> Column:
        at = F.when(spaced, i - F.length(F.regexp_replace(F.substring(text, F.lit(1), i), "[^ ]", ""))).otherwise(i)
        low = (F.when(c.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, seed, at))
               .when(c.rlike(r"\p{IsGreek}"), _pick(GREEK, seed, at)).otherwise(_pick(LATIN, seed, at)))
        return (F.when(c.rlike("[0-9]"), _pick("0123456789", seed, at))
                .when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}"), low).otherwise(c))

    spaced = F.instr(text, " ") > 0
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(text: Column, seed: Column, keep: Column) -> Column:
    """Digits replaced by their place among the digits, counted from the
    right, so that every way of writing a number gives the same ones; the
    first ``keep`` digits stay."""
    total = F.length(F.regexp_replace(text, "[^0-9]", ""))

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(text, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]") & (before >= keep), _pick("0123456789", seed, total - before)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _name(text: Column, kind: Column, seed: Column, draw: Column) -> Column:
    """A made-up name of three or more syllables and an ending, of the script,
    the gender and the case of the name."""
    script = script_of(text)

    def build(s: str) -> Column:
        syllables = F.array(*[F.lit(x) for x in SYLLABLES[s]])
        parts = [F.get(syllables, _number(seed, F.lit(i), len(SYLLABLES[s]))) for i in range(3)]
        parts.append(F.when(_longer(draw) > 0, F.array_join(F.transform(
            F.sequence(F.lit(1), _longer(draw)), lambda i: F.get(syllables, _number(seed, -i, len(SYLLABLES[s])))), "")
                            ).otherwise(""))
        ends = reduce(lambda rest, g: F.when(kind == g[0], F.array(*[F.lit(x) for x in ENDINGS[s, g[1]]]))
                      .otherwise(rest), [("given-f", "f"), ("given-m", "m"), ("given-n", "n")],
                      F.array(*[F.lit(x) for x in ENDINGS[s, "s"]]))
        return F.concat(*parts, F.get(ends, _number(seed, F.lit(9), 4)))

    low = F.when(script == "cyrillic", build("cyrillic")).when(script == "greek", build("greek")).otherwise(
        build("latin"))
    return F.when(text == F.upper(text), F.upper(low)).otherwise(F.initcap(low))


def surrogate(text: Column, kind: Column, draw: Column, key: str) -> Column:
    """The replacement of one unit."""
    return let(canonical(text, kind), lambda canon: let(
        seed_of(kind, canon, draw, key), lambda seed: _surrogate(text, kind, canon, draw, seed)))


def _surrogate(text: Column, kind: Column, canon: Column, draw: Column, seed: Column) -> Column:
    at = F.instr(text, "@")
    dot = F.length(text) - F.instr(F.reverse(text), ".") + 1
    same = lambda part, s: let(part, lambda t: _same_format(t, s))
    mail = F.concat(same(F.substring(text, F.lit(1), at - 1), seed), _more(LATIN, seed, draw), F.lit("@"),
                    let(F.sha2(seed, 256), lambda s: same(F.substring(text, at + 1, dot - at - 1), s)),
                    F.substring(text, dot, F.length(text)))
    octets = F.array_join(F.transform(F.split(text, r"\."), lambda o, i: (_number(seed, i, 254) + 1).cast("string")), ".")
    # The country code stays, with the 00 of a writing that has one.
    country = let(F.length(F.regexp_extract(canon, COUNTRY, 0)), lambda n: F.when(n == 0, n).otherwise(
        F.length(F.regexp_replace(text, "[^0-9]", "")) - F.length(canon) + n))
    more = _more("0123456789", seed, draw)
    return (F.when(kind.isin("title", "particle"), text).when(kind == "email", mail).when(kind == "ip", octets)
            .when(kind == "ip6", _ip6(text, canon, draw, seed)).when(kind == "initial", _same_format(text, seed))
            .when(kind == "phone", F.concat(let(country, lambda keep: _digits(text, seed, keep)), more))
            .when(kind.isin("card", "ssn"), F.concat(_digits(text, seed, F.lit(0)), more))
            .when(kind == "iban", F.concat(F.substring(text, 1, 2), same(
                F.substring(text, F.lit(3), F.length(text)), seed), more))
            .otherwise(_name(text, kind, seed, draw)))


def exceptions(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon) -> (kind, canon, draw) of those whose first
    surrogate is taken. The canonical forms are compared, which all ways of
    writing share. Of entities with the same surrogate the first in order of
    its hash keeps it."""
    first = entities.select("kind", "canon")
    real = first.select(F.col("kind").alias("k"), F.col("canon").alias("r"))
    state = first.withColumn("draw", F.lit(0))
    while True:
        drawn = state.withColumn("s", canonical(surrogate(F.col("canon"), F.col("kind"), F.col("draw"), key),
                                                F.col("kind")))
        owner = drawn.groupBy("kind", "s").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("draw", F.xxhash64("canon"), "canon"))["canon"].alias("owner"))
        taken = owner.join(real, (F.col("kind") == F.col("k")) & (F.col("s") == F.col("r")), "left").filter(
            "n > 1 or r is not null").select(F.col("kind").alias("k"), F.col("s").alias("t"), "owner", "r")
        again = drawn.join(taken, (F.col("kind") == F.col("k")) & (F.col("s") == F.col("t")), "left").withColumn(
            "redraw", F.col("t").isNotNull() & (F.col("r").isNotNull() | (F.col("canon") != F.col("owner"))))
        again = cut_lineage(again.select("kind", "canon", F.when(F.col("redraw"), F.col("draw") + 1)
                                         .otherwise(F.col("draw")).alias("draw"), "redraw"))
        state = again.drop("redraw")
        if again.filter("redraw").isEmpty():
            return state.filter("draw > 0").select("kind", "canon", "draw")


#: Kinds of words that stay, or that many people share.
NOT_IDENTIFYING = ("title", "particle", "initial")


def find_entities(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(NO_EMAIL), F.lit(0)))


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with ``text`` rewritten, and the columns ``__entities`` (kinds of
    the units found, in order). ``docs`` is read twice, so it should be a
    table."""
    marked = docs.withColumn("__found", F.coalesce(find_entities(col(text)), F.array().cast("array<string>")))
    each = marked.select(F.explode(F.array_distinct("__found")).alias("e")).distinct()
    each = each.select(F.explode(units(F.col("e"))).alias("u")).select("u.kind", "u.text").filter(
        ~F.col("kind").isin(*NOT_IDENTIFYING))
    entities = cut_lineage(each.select("kind", canonical(F.col("text"), F.col("kind")).alias("canon")).distinct())
    redrawn = cut_lineage(exceptions(entities, key))
    n = redrawn.count()
    plain = F.create_map().cast("map<string,int>")
    if not n:
        return _rewritten(marked.withColumn("__draws", plain), text, key)
    lists = marked.filter(F.size("__found") > 0).select("__found").distinct()
    lists = lists.select("__found", F.explode(F.flatten(F.transform("__found", units))).alias("u")).select(
        "__found", F.col("u.kind").alias("kind"), canonical(F.col("u.text"), F.col("u.kind")).alias("canon"))
    small = F.broadcast(redrawn) if n <= BROADCAST_EXCEPTIONS else redrawn
    hit = lists.join(small, ["kind", "canon"]).groupBy(F.col("__found").alias("__list")).agg(
        F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "canon"), "draw"))).alias("__draws"))
    hit = cut_lineage(hit)
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_EXCEPTIONS // 10 else hit
    none = marked.filter(F.size("__found") == 0).withColumn("__draws", plain)
    some = marked.filter(F.size("__found") > 0).join(hit, F.col("__found") == F.col("__list"), "left").drop("__list")
    some = some.withColumn("__draws", F.coalesce("__draws", plain))
    return _rewritten(none.unionByName(some), text, key)


def _rewritten(marked: DataFrame, text: str, key: str) -> DataFrame:
    def one(u: Column) -> Column:
        named = F.concat_ws("\x1f", u["kind"], canonical(u["text"], u["kind"]))
        return surrogate(u["text"], u["kind"], F.coalesce(F.try_element_at("__draws", named), F.lit(0)), key)

    def zipped(rest: Column, inner: Column) -> Column:
        return F.array_join(F.zip_with(rest, inner, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    # The words of a document's names, each with its first kind, and in capitals.
    named = F.filter(F.flatten(F.transform("__found", units)), lambda u: F.startswith(u["kind"], F.lit("given-"))
                     | (u["kind"] == "surname"))
    words = let(named, lambda n: F.array_distinct(F.flatten(F.transform(n, lambda u: F.array(
        u["text"], F.upper(u["text"]))))))
    marked = marked.withColumn("__names", F.when(F.size("__found") > 0, named)).withColumn(
        "__bare", F.when(F.size("__names") > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"),
                                                        F.lit(r")(?![\p{L}\p{N}])"))))

    def mention(w: Column) -> Column:
        u = F.get(F.filter("__names", lambda n: (n["text"] == w) | (F.upper(n["text"]) == w)), F.lit(0))
        return let(F.struct(w.alias("text"), u["kind"].alias("kind")), one)

    def mentions(piece: Column) -> Column:
        found = F.regexp_extract_all(piece, F.col("__bare"), F.lit(0))
        return F.when(F.col("__bare").isNotNull() & F.rlike(piece, F.col("__bare")), zipped(
            F.split(piece, F.col("__bare"), -1), F.transform(found, mention))).otherwise(piece)

    between = F.transform(F.split(col(text), ENTITY, -1), mentions)
    done = F.when(F.size("__found") > 0, zipped(between, F.transform(
        "__found", lambda e: F.array_join(F.transform(units(e), one), " ")))).otherwise(col(text))
    kinds = F.flatten(F.transform("__found", lambda e: F.transform(units(e), lambda u: u["kind"])))
    return marked.withColumn("__entities", kinds).withColumn(text, done).drop("__found", "__draws", "__names", "__bare")
