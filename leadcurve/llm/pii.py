"""Surrogates for personal data: keyed, of the same type and format, distinct, and the same wherever an entity recurs."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.marks import marked_rows
from leadcurve.llm.work import Work

KEY = "surrogates-1"
#: After so many attempts an entity's format is taken to be full, and every further one is wider.
WIDEN = 5

#: Titles by gender, given names that surrogates are made of by gender and script, and syllables of surnames.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Mme", "Madame", "Doña", "Госпожа"),
    "x": ("Dr", "Prof", "Professor"),
}
GIVEN = {
    ("f", "latin"): ("Alice", "Anna", "Carla", "Clara", "Diana", "Elena", "Emma", "Eva", "Helen", "Ines", "Julia", "Karen", "Laura", "Lucy", "Maria", "Marta", "Mary", "Nina", "Olivia", "Paula", "Sarah", "Silvia", "Sophie", "Susan"),
    ("m", "latin"): ("Adam", "Bruno", "Carlos", "Daniel", "David", "Felix", "Frank", "Georg", "Hans", "Hugo", "James", "John", "Jorge", "Karl", "Lucas", "Marco", "Martin", "Oscar", "Paul", "Peter", "Robert", "Simon", "Thomas", "Victor"),
    ("x", "latin"): ("Alex", "Chris", "Jamie", "Jordan", "Kim", "Morgan", "Robin", "Sam"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Татьяна"),
    ("m", "cyrillic"): ("Андрей", "Борис", "Виктор", "Иван", "Олег", "Павел", "Пётр", "Сергей"),
    ("x", "cyrillic"): ("Женя", "Саша", "Валя", "Шура"),
}
#: Further given names that are looked for, none of them a common word.
LOOKED_FOR = {
    "f": (
        "Amanda", "Andrea", "Angela", "Barbara", "Beatriz", "Brenda", "Brigitte", "Camille", "Carmen", "Carolyn", "Catherine", "Christina", "Claudia", "Cynthia", "Deborah", "Dorothy", "Elizabeth", "Emily",
        "Françoise", "Gabriela", "Heidi", "Ingrid", "Isabel", "Jennifer", "Jessica", "Katharina", "Kimberly", "Linda", "Lisa", "Lucía", "Margaret", "Marie", "Melissa", "Michelle", "Monika", "Nancy", "Nathalie",
        "Nicole", "Pamela", "Patricia", "Petra", "Pilar", "Rachel", "Rebecca", "Rosa", "Sabine", "Sandra", "Sharon", "Stephanie", "Sylvie", "Teresa", "Ursula", "Valérie", "Verónica", "Virginia",
    ),
    "m": (
        "Alejandro", "Alexander", "Andrew", "Anthony", "Antonio", "Benjamin", "Brian", "Charles", "Christopher", "Dennis", "Diego", "Donald", "Edward", "Eric", "Fernando", "Francisco", "François", "Friedrich",
        "Gary", "George", "Gregory", "Günter", "Heinrich", "Henry", "Jacob", "Jason", "Javier", "Jean", "Jeffrey", "Jonathan", "José", "Joseph", "Joshua", "Juan", "Jürgen", "Kenneth", "Kevin", "Klaus", "Laurent",
        "Luis", "Manuel", "Matthew", "Michael", "Miguel", "Nicholas", "Patrick", "Pedro", "Philippe", "Pierre", "Richard", "Ronald", "Ryan", "Samuel", "Sebastian", "Stefan", "Stephen", "Steven", "Timothy", "Walter", "William", "Wolfgang",
    ),
}
SYLLABLES = {
    "latin": ("ba", "bel", "car", "dan", "der", "fen", "gal", "har", "kel", "lor", "mar", "nov", "per", "ral", "sen", "tor"),
    "cyrillic": ("ба", "вел", "гор", "дан", "зар", "кол", "лор", "мар", "нов", "пер", "ряб", "сел", "тар", "фед", "хол", "чер"),
}

SECRET_WORDS = r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API_KEY)"
#: What stands between such a word and its value; what may enclose a value, and end a sentence or a bracket after one that is not enclosed.
SECRET_IS = rf"{SECRET_WORDS}\x5C?[\x22\x27]? ?[=:] ?"
QUOTE = r"\x5C?[\x22\x27]"
TAIL = r".,;)\]}>\x22\x27\x5C"
#: To the closing quote on the line, or to the next blank. After a colon, fewer than 8 characters need a digit or a sign to be no plain word.
SECRET_VALUE = (
    rf"(?:(?<q>{QUOTE})(?![^\r\n]{{0,3}}?(?<!\x5C)\k<q>)[^\r\n]{{4,}}?(?<!\x5C)\k<q>"
    rf"|(?:(?!{QUOTE})|(?<p>{QUOTE})(?![^\r\n]*?(?<!\x5C)\k<p>))(?=\S*[^\s_=*#~+/:{TAIL}-])(?:(?=\S{{8}})|(?<=[=] ?)(?=\S{{4}})|(?=\S{{4}})(?=\S*[0-9@#$%&*+^~]))\S++)"
)
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _choice(words) -> str:
    return "(?:" + "|".join(words) + ")"


def _given(gender: str) -> list[str]:
    return [n for (g, _), names in GIVEN.items() if g == gender for n in names] + list(LOOKED_FOR.get(gender, ()))


def _by_initial(words) -> str:
    """One of the words, those with the same first letter tried together."""
    initials = sorted({w[0] for w in words})
    return _choice(f"{c}{_choice(sorted((w[1:] for w in words if w[0] == c), key=lambda w: (-len(w), w)))}" for c in initials)


_TITLE = _choice(t for titles in TITLES.values() for t in titles)
#: A part of a name: capitalised or in capitals, and no title.
NAME = rf"(?!{_TITLE}(?!\p{{L}}))\p{{Lu}}(?:\p{{Ll}}+|\p{{Lu}}+)"
def _starting(first: str, *patterns: str) -> str:
    """Patterns that are only tried where the next character is one of ``first``."""
    return f"(?=[{first}])(?:{'|'.join(patterns)})"


_KNOWN = rf"{_by_initial(_given("f") + _given("m"))}(?!\p{{L}})"
HEX = "[0-9A-Fa-f]{1,4}"
#: Global, local and private addresses of version 6, in full or with one gap.
IPV6 = rf"(?<![0-9A-Za-z:.])(?:[23][0-9A-Fa-f]{{3}}|[fF][c-eC-E][0-9A-Fa-f]{{2}})(?:(?::{HEX}){{7}}|(?::{HEX}){{0,5}}::{HEX}(?::{HEX}){{0,4}})(?![0-9A-Za-z:]|\.[0-9])"
#: What is taken for personal data. All are linear in the text: no part can start inside what it matched.
PATTERN = "|".join(
    (
        _starting(
            "0-9+(fF",
            rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
            r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
            r"(?<![0-9+])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
            r"(?<![0-9+])3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])",
            # seven digits at least: less is a figure with its sign
            r"\+(?=(?:[ .()-]{0,3}[0-9]){7})[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,6}(?![0-9])",
            r"(?<![0-9A-Za-z+.-])(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
            IPV6,
        ),
        r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
        _starting(
            "PpTtSsAa",
            r"(?<![A-Za-z0-9])" + SECRET_IS + SECRET_VALUE,
            r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
        ),
        _starting(
            r"\p{Lu}",
            r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
            rf"(?<!\p{{L}})(?:{_TITLE}\.? {NAME}(?:[ -]{NAME}){{0,2}}|{_KNOWN}(?: {NAME}){{1,2}})",
        ),
    )
)
#: A text without any of these holds nothing of the above.
HINT = "|".join(("[0-9@]", _starting("PpTtSsAa", SECRET_WORDS, "AKIA"), _starting(r"\p{Lu}", rf"(?<!\p{{L}})(?:{_TITLE}\.? |{_KNOWN} )\p{{Lu}}")))

_TYPE = rf"""case
    when m rlike r'^(?:{SECRET_IS}|AKIA[0-9A-Z]{{16}}$)' then 'secret'
    when m like '%@%' then 'email'
    when m rlike r'^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' then 'ip'
    when m rlike r'^[0-9A-Fa-f]+:' then 'ipv6'
    when m rlike r'^[A-Z]{{2}}[0-9]{{2}}' then 'iban'
    when m rlike r'^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn'
    when m rlike r'^[0-9]' and length(regexp_replace(m, '[^0-9]', '')) > 12 then 'card'
    when m rlike r'^[+(0-9]' then 'phone'
    else 'name' end"""

_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_TITLE_OF = rf"regexp_extract(m, r'^{_TITLE}(?=[. ])', 0)"
#: A secret without what leads to it and encloses it.
_LEAD = rf"regexp_extract(m, r'^{SECRET_IS}(?:{QUOTE})?', 0)"
_VALUE = rf"regexp_replace(m, r'^{SECRET_IS}', '')"
_BODY = rf"""case when {_LEAD} = '' then m
    when {_VALUE} rlike r'(?s)^({QUOTE}).*\1$' then substring({_VALUE}, case when left({_VALUE}, 1) = chr(92) then 3 else 2 end, length({_VALUE}) - case when left({_VALUE}, 1) = chr(92) then 4 else 2 end)
    else regexp_extract({_VALUE}, r'(?s)^(?:{QUOTE})?(.*[^{TAIL}])', 1) end"""


def _gender() -> str:
    def one_of(column, words):
        return f"{column} in ({', '.join(repr(w) for w in words)})"

    token = f"get(regexp_extract_all(regexp_replace(m, r'^{_TITLE}[.]? ', ''), r'{NAME}', 0), 0)"
    return f"case when {one_of(token, _given('f'))} or {one_of(_TITLE_OF, TITLES['f'])} and not {one_of(token, _given('m'))} then 'f' when {one_of(token, _given('m'))} or {one_of(_TITLE_OF, TITLES['m'])} then 'm' else 'x' end"


#: The entities of a mention as keys "type|canonical form"; a name has one for each part.
_KEYS = rf"""case {_TYPE}
    when 'email' then array(concat('email|', lower(m)))
    when 'secret' then array(concat('secret|', {_BODY}))
    when 'ip' then array(concat('ip|', m))
    when 'ipv6' then array(concat('ipv6|', lower(m)))
    when 'iban' then array(concat('iban|', replace(m, ' ', '')))
    when 'ssn' then array(concat('ssn|', {_DIGITS}))
    when 'card' then array(concat('card|', {_DIGITS}))
    when 'phone' then array(concat('phone|', case when length({_DIGITS}) = 11 and (m like '+1%' or m like '1%') then substring({_DIGITS}, 2) when m like '+%' then concat('+', {_DIGITS}) else {_DIGITS} end))
    else transform(regexp_extract_all(regexp_replace(m, r'^{_TITLE}[.]? ', ''), r'{NAME}', 0), (t, i) -> concat(
        case when i = 0 and not ({_TITLE_OF} <> '' and size(regexp_extract_all(regexp_replace(m, r'^{_TITLE}[.]? ', ''), r'{NAME}', 0)) = 1) then concat('given_', {_gender()}) else case when t rlike 'а$' then 'surname_f' else 'surname' end end,
        case when t rlike r'\p{{IsCyrillic}}' then '_cyrillic|' else '_latin|' end, lower(t)))
    end"""


def _mentions(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", "xxhash64(text) as text_key", f"regexp_extract_all(text, r'{PATTERN}', 0) as mentions").where("size(mentions) > 0")


def _hash(of: str) -> str:
    """A keyed number for column key, the attempt and ``of``."""
    return f"cast(conv(substring(sha2(concat_ws('|', secret, key, attempt, {of}), 256), 1, 12), 16, 10) as bigint)"


def _pick(words, of: str) -> str:
    return f"get(array({', '.join(repr(w) for w in words)}), cast({_hash(of)} % {len(words)} as int))"


def _letters(source: str, keep: str, hashed: str = None) -> str:
    """Every digit of ``source`` for a digit and every letter for a letter, but for the characters where ``keep`` holds (of i from 0, c)."""
    number = hashed or _hash("i")
    span = "case when canonical rlike '^[0-9a-fA-F]+$' then 6 else 26 end"
    return (
        f"array_join(transform(filter(split({source}, ''), c -> c <> ''), (c, i) -> case when {keep} then c when c rlike '[0-9]' then cast({number} % 10 as string)"
        f" when c rlike '[a-z]' then char(97 + {number} % {span}) when c rlike '[A-Z]' then char(65 + {number} % {span}) else c end), '')"
    )


def _secret() -> str:
    """Every digit for a digit, letter for a letter and other sign for a sign; what parts a value stays, and the start of an access key. Long after others a longer one, as short ones may all be taken."""
    number = "cast(conv(substring(sha2(concat_ws('|', seed, i), 256), 1, 12), 16, 10) as bigint)"
    made = _letters("canonical", "i < 4 and canonical rlike '^AKIA[0-9A-Z]{16}$' or c rlike r'[\\s./:=_+,;()\\[\\]{}<>\\x22\\x27\\x5C-]'", number)
    made = made.replace(" else c end)", rf" when c rlike r'\p{{Lu}}' then char(65 + {number} % 26) when c rlike r'\p{{L}}' then char(97 + {number} % 26) when c rlike r'\p{{N}}' then cast({number} % 10 as string) else substring('!#$%&*?@^~', cast({number} % 10 as int) + 1, 1) end)")
    longer = f"case when cast(attempt as int) > 8 then substring(sha2(concat(seed, '|longer'), 256), 1, cast(attempt as int) - 4) else '' end"
    # the seed is made once, however long the value
    return f"get(transform(array(sha2(concat_ws('|', secret, key, attempt), 256)), seed -> concat({made}, {longer})), 0)"


def _luhn(number: str) -> str:
    """Sum of a number's digits, every second one from the right doubled."""
    digit = f"cast(substring({number}, length({number}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({number}) - 1), 0, (s, i) -> s + case when i % 2 = 0 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)"


def _mod97(text: str) -> str:
    value = "case when c rlike '[0-9]' then (s * 10 + cast(c as int)) % 97 else (s * 100 + ascii(upper(c)) - 55) % 97 end"
    return f"aggregate(filter(split({text}, ''), c -> c <> ''), 0, (s, c) -> {value})"


def _candidates(pending: DataFrame, attempt: int, secret: str) -> DataFrame:
    """Pending entities with the surrogate of one attempt."""
    df = pending.withColumns({"secret": F.lit(secret), "attempt": F.lit(str(attempt))})
    # where a format is full, more of its own characters follow
    extra = max(attempt - WIDEN, 0)
    digits = f"substring(conv(substring(sha2(concat_ws('|', secret, key, attempt, 'more'), 256), 1, 15), 16, 10), 2, {min(extra, 12)})"
    letters = f"translate(substring(sha2(concat_ws('|', secret, key, attempt, 'more'), 256), 1, {extra}), '0123456789', 'ghijklmnop')"
    # an email's domain has the surrogate of that domain, the same for all its addresses; the top level stays
    email = f"concat({_letters("substring_index(canonical, '@', 1)", 'false')}, {letters}, '@', domain)"
    domain = f"concat({_letters("substring(canonical, 1, length(canonical) - length(substring_index(canonical, '.', -1)) - 1)", 'false')}, {letters}, '.', substring_index(canonical, '.', -1))"
    octet = f"case when {attempt} > 8 or length(o) = 3 then 100 + {_hash('i')} % 156 when length(o) = 2 then 10 + {_hash('i')} % 90 else 1 + {_hash('i')} % 9 end"
    private = "canonical rlike '^(10|127)[.]' and i = 0 or canonical rlike '^192[.]168[.]' and i < 2 or canonical rlike '^172[.](1[6-9]|2[0-9]|3[01])[.]' and i < 2"
    # a full private network goes on in others, and should all addresses be taken, in further places
    kept_octet = f"({private})" if attempt <= 16 else "false"
    ip = f"concat(array_join(transform(split(canonical, '[.]'), (o, i) -> case when {kept_octet} then o else cast({octet} as string) end), '.'){''.join(f", '.', cast({_hash(str(90 + k))} % 256 as string)" for k in range(max(attempt - 32, 0)))})"
    six = _letters("canonical", "i < 4").replace("then char(97 + ", "then char(97 + ").replace("case when canonical rlike '^[0-9a-fA-F]+$' then 6 else 26 end", "6")
    six = f"concat({six}, {f"case when length(regexp_replace(canonical, '[^:]', '')) < 7 then ':' else '' end, left({letters.replace('ghijklmnop', 'abcdefabcd')}, 4)" if extra else "''"})"
    first = f"when i in (0, 3) then cast(2 + {_hash('i')} % 8 as string)"
    country = "i < 3 and canonical like '+%'" if attempt <= WIDEN else "i < 1 and canonical like '+%'"
    phone = _letters("canonical", country).replace("when c rlike '[0-9]'", f"{first.replace('when i', 'when length(canonical) = 10 and i')} when c rlike '[0-9]'", 1)
    ssn = _letters("canonical", "false").replace("when c rlike '[0-9]'", f"when i in (0, 4, 8) then cast(1 + {_hash('i')} % 8 as string) when c rlike '[0-9]'", 1)
    givens = " ".join(
        f"when 'given_{g}_{script}' then concat({_pick(names, '0')}{''.join(f", '-', {_pick(names, str(k))}" for k in range(1, min(attempt, 12) + 1))})" for (g, script), names in GIVEN.items()
    )
    ends = {("surname_f", "cyrillic"): "ова", ("surname", "cyrillic"): "ов"}
    surnames = " ".join(
        f"when '{kind}_{script}' then initcap(concat({', '.join(_pick(SYLLABLES[script], str(k)) for k in range(3 + min(attempt, 8)))}, '{ends.get((kind, script), '')}'))" for script in SYLLABLES for kind in ("surname", "surname_f")
    )
    made = df.select(
        "*",
        F.expr(
            f"""case kind when 'email' then {email} when 'domain' then {domain} when 'ip' then {ip} when 'ipv6' then {six}
            when 'phone' then concat({phone}, {digits}) when 'ssn' then concat({ssn}, {digits})
            when 'card' then concat({_letters('canonical', 'i = 0')}, {digits})
            when 'iban' then concat({_letters('canonical', 'i < 2')}, {digits})
            when 'secret' then {_secret()} {givens} {surnames} end"""
        ).alias("raw"),
    )
    # the last digit of a card and the check digits of an IBAN are right if they were
    body = "concat(substring(raw, 1, length(raw) - 1), '0')"
    card = f"concat(substring(raw, 1, length(raw) - 1), cast((10 - {_luhn(body)} % 10 + case when {_luhn('canonical')} % 10 = 0 then 0 else 1 + {_hash('99')} % 9 end) % 10 as string))"
    shifted = "concat(substring(raw, 5), substring(raw, 1, 2), '00')"
    iban = f"concat(substring(raw, 1, 2), lpad(cast(98 - {_mod97(shifted)} as string), 2, '0'), substring(raw, 5))"
    right = f"{_mod97('concat(substring(canonical, 5), substring(canonical, 1, 4))')} = 1"
    return made.selectExpr("key", "canonical", "kind", f"case when kind = 'card' then {card} when kind = 'iban' and {right} then {iban} else raw end as surrogate").withColumn(
        "form", F.expr("concat(split_part(kind, '_', 1), '|', lower(surrogate))")
    )


def _assigned(known: DataFrame, work: Work, secret: str, name: str) -> DataFrame:
    """key, canonical and surrogate of entities (key, kind, canonical, domain)."""
    taken = known.selectExpr("concat(split_part(kind, '_', 1), '|', lower(canonical)) as form").distinct()
    done, pending = None, known
    for attempt in itertools.count():
        tried = work.keep(_candidates(pending, attempt, secret), f"{name}-tried-{attempt}")
        free = tried.join(taken, "form", "left_anti")
        if done is not None:
            free = free.join(done.select("form"), "form", "left_anti")
        won = work.keep(free.groupBy("form").agg(F.min_by(F.struct("key", "canonical", "surrogate"), "key").alias("best")).selectExpr("form", "best.key as key", "best.canonical as canonical", "best.surrogate as surrogate"), f"{name}-won-{attempt}")
        done = won if done is None else done.unionByName(won)
        pending = work.keep(pending.join(won.select("key"), "key", "left_anti"), f"{name}-pending-{attempt}")
        if pending.isEmpty():
            return done.select("key", "canonical", "surrogate")


def surrogates(entities: DataFrame, work: Work, secret: str = KEY) -> DataFrame:
    """key and surrogate of every distinct entity (column key, "type|canonical form").

    Attempt by attempt, a candidate is made from the secret, the entity and
    the number of the attempt. It is refused if it is itself an entity of the
    texts, if another entity has been given it, or if several entities come
    to it at once; of these the first by key gets it. The refused ones try
    again until none is left, so no two entities share a surrogate and none
    gets a value that was in the texts. A format may have no free values
    left (26 domains of one letter that are all in use): from the sixth
    attempt on candidates are longer, more so with every attempt, so
    the attempts end. Domains of email addresses are entities too, and come
    first.
    """
    parts = entities.selectExpr("key", "split_part(key, '|', 1) as kind", "substring(key, locate('|', key) + 1) as canonical", "cast(null as string) as domain")
    known = work.keep(parts, "entities")
    of = "substring_index(canonical, '@', -1)"
    mails = known.where("kind = 'email'")
    domains = work.keep(mails.selectExpr(f"{of} as canonical").distinct().selectExpr("concat('domain|', canonical) as key", "'domain' as kind", "canonical", "cast(null as string) as domain"), "domains")
    if domains.isEmpty():
        return _assigned(known, work, secret, "entity").select("key", "surrogate")
    names = _assigned(domains, work, secret, "domain").selectExpr("canonical as own", "surrogate as domain")
    placed = mails.drop("domain").join(names, F.expr(f"{of} = own")).select("key", "kind", "canonical", "domain")
    known = work.keep(known.where("kind <> 'email'").unionByName(placed), "placed")
    return _assigned(known, work, secret, "entity").select("key", "surrogate")


#: A mention with its letters and digits, from the last backwards, taken from its surrogate; separators and case stay.
_STREAM = "regexp_replace(get(<new>, 0), '[^A-Za-z0-9]', '')"
_FILLED = (
    "reverse(aggregate(filter(split(reverse(<mention>), ''), c -> c <> ''), named_struct('out', '', 'left', reverse(" + _STREAM + ")),"
    " (a, c) -> case when not c rlike '[A-Za-z0-9]' or a.left = '' then named_struct('out', concat(a.out, c), 'left', a.left)"
    " else named_struct('out', concat(a.out, case when c rlike '[A-Z]' then upper(left(a.left, 1)) else left(a.left, 1) end), 'left', substring(a.left, 2)) end, a -> a.out))"
)
_PARTS = rf"regexp_extract_all(regexp_replace(<mention>, r'^{_TITLE}[.]? ', ''), r'{NAME}', 0)"
_NAMED = (
    rf"array_join(zip_with(split(<mention>, r'(?<={_TITLE}[.]? |^|[ -]){NAME}', -1), zip_with({_PARTS}, <new>, (old, new) -> case when old = upper(old) then upper(new) else new end),"
    " (gap, name) -> concat(coalesce(gap, ''), coalesce(name, ''))), '')"
)


def _replaced() -> str:
    """What stands for x.m, given the entities it names (x.keys) and surrogate_of."""
    filled, named = (e.replace("<mention>", "x.m").replace("<new>", "transform(x.keys, k -> element_at(surrogate_of, k))") for e in (_FILLED, _NAMED))
    lead, body = (e.replace("(m,", "(x.m,").replace("then m\n", "then x.m\n") for e in (_LEAD, _BODY))
    secret = f"concat({lead}, element_at(surrogate_of, get(x.keys, 0)), substring(x.m, length({lead}) + length({body}) + 1))"
    whole = "element_at(surrogate_of, get(x.keys, 0))"
    # a wider surrogate does not fit the mention's letters and digits one by one
    wider = f"length(regexp_replace({whole}, '[^A-Za-z0-9]', '')) > length(regexp_replace(x.m, '[^A-Za-z0-9]', ''))"
    return f"case when get(x.keys, 0) like 'secret|%' then {secret} when get(x.keys, 0) rlike '^ip(v6)?[|]' or get(x.keys, 0) not rlike '^(given|surname)' and {wider} then {whole} when get(x.keys, 0) rlike '^(given|surname)' then {named} else {filled} end"


def replace_entities(docs: DataFrame, secret: str = KEY) -> DataFrame:
    """Every document with its columns, its text with surrogates for personal data, and n_replaced, kinds_replaced.

    Taken for personal data: email and internet addresses, phone, card, social
    security and IBAN numbers, keys and passwords, and names after a title or
    with one of the given names of ``GIVEN`` and ``LOOKED_FOR`` (fixed lists;
    other names stay). A surrogate has the format of what it replaces:
    digits for digits, letters for letters, the same separators and case;
    addresses of a domain keep one domain, private networks stay private,
    check digits stay right, a name keeps its gender and script. A secret is
    all that stands between its quotes, or up to the next blank without the
    marks that end a sentence, of any length and any characters; values of
    fewer than 4 characters, and after a colon words of fewer than 8 letters,
    are taken for text. An entity is
    the same in all its spellings (a phone number with or without separators)
    and has the same surrogate in every document. ``surrogates`` says how
    distinctness is kept.

    Texts without a digit, an at sign, a title or a known name are passed over
    after one look. Ids and entities of the others are shuffled to find the
    surrogates, and only texts with an entity to be rewritten. A null text stays null
    and an empty one empty, both with n_replaced 0. Rows alike in doc_id and
    text are rewritten alike and stay as many. Extra columns pass through,
    whatever their names; two counts are added after them as n_replaced and
    kinds_replaced, which input columns of these names give way to.
    """
    spark = docs.sparkSession
    work = Work(spark, "pii")
    rest = [c for c in docs.columns if c.lower() not in ("n_replaced", "kinds_replaced")]
    found = work.keep(_mentions(docs.where(F.col("text").rlike(HINT)).selectExpr("cast(doc_id as bigint) as doc_id", "text")), "found")
    keyed = found.selectExpr("doc_id", "text_key", "explode(array_distinct(flatten(transform(mentions, m -> " + _KEYS + ")))) as key").distinct()
    keyed = work.keep(keyed, "keyed")
    named = surrogates(keyed.select("key").distinct(), work, secret)
    own = keyed.join(named, "key").groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_list(F.struct("key", "surrogate"))).alias("surrogate_of"))
    own = work.keep(own, "own").selectExpr("doc_id as own_id", "text_key as own_key", "surrogate_of")
    row = F.struct(*[docs[c] for c in rest]).alias("row")
    marked = marked_rows(docs.select(row, docs["doc_id"].cast("bigint").alias("doc_id")), own.selectExpr("own_id as doc_id"))
    plain = marked.where("not marked").selectExpr("row.*", "0L as n_replaced", "'' as kinds_replaced")
    joined = marked.where("marked").join(own, F.expr("doc_id <=> own_id and xxhash64(row.text) = own_key"), "left")
    parts = joined.select("row", "surrogate_of", F.expr(f"case when surrogate_of is not null then transform(regexp_extract_all(row.text, r'{PATTERN}', 0), m -> named_struct('m', m, 'keys', {_KEYS})) end as found"))
    outs = F.expr(f"transform(found, x -> {_replaced()})")
    text = f"case when found is null then row.text else array_join(zip_with(split(row.text, r'{PATTERN}', -1), outs, (gap, new) -> concat(coalesce(gap, ''), coalesce(new, ''))), '') end"
    kinds = "array_join(array_sort(array_distinct(transform(flatten(transform(coalesce(found, array()), x -> x.keys)), k -> split_part(split_part(k, '|', 1), '_', 1)))), ',')"
    columns = [F.expr(text).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in rest]
    changed = parts.withColumn("outs", outs).select(*columns, F.expr("cast(coalesce(size(found), 0) as bigint)").alias("n_replaced"), F.expr(kinds).alias("kinds_replaced"))
    return plain.unionAll(changed)
