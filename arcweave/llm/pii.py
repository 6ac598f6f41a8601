"""Surrogates for personal data and secrets.

Entities are found in whole texts; each distinct one gets a replacement drawn from a keyed hash
of itself, of the same kind and shape: digits for digits, letters for letters in their case and
script, valid check digits, a name's gender and script. The same entity is replaced the same way
everywhere. Names are found after a title, by a known given name before another name, or by a
family name before an honorific; then each bare mention of a name that was found in a document is
looked for in it. Names without any of these stay: no list of names is complete. Replacements are
checked over the whole corpus: two entities of a kind never share one, and none equals an entity
that occurs; whoever loses such a clash draws again. An address is a mailbox at a domain, and
each of the two is replaced for itself: different domains stay different, colleagues stay
colleagues. Each text is matched once; texts, with what was found in them, go to a table in the
shared folder, and only those with entities are joined to their replacements.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.llm.common import cut, written

KEY = "arcweave-demo-key"

# Given names by gender and script, and syllables of family names by script.
GIVEN = {
    ("f", "latin"): "Alice Amelia Barbara Caroline Charlotte Christine Eleanor Elizabeth Francesca Gabriela Hannah Isabella Johanna Katharina Margaret Mathilde Patricia Rebecca Susanne Veronica".split(),
    ("m", "latin"): "Alexander Anthony Benjamin Christopher Edward Ferdinand Frederick Guillermo Harrison Jonathan Leonard Maximilian Nicholas Patrick Raymond Sebastian Theodore Vincent William Zachary".split(),
    ("f", "cyrillic"): "Анастасия Валентина Екатерина Людмила Маргарита Надежда Светлана Татьяна".split(),
    ("m", "cyrillic"): "Александр Владимир Дмитрий Константин Михаил Николай Станислав Тимофей".split(),
    ("f", "greek"): "Αλεξάνδρα Βασιλική Δήμητρα Ευαγγελία Θεοδώρα Καλλιόπη Παρασκευή Στυλιανή".split(),
    ("m", "greek"): "Αθανάσιος Βασίλειος Γρηγόριος Ευάγγελος Θεόδωρος Λεωνίδας Παναγιώτης Στυλιανός".split(),
    ("f", "arabic"): "أسماء بثينة جميلة رقية سلمى عفاف نادية وداد".split(),
    ("m", "arabic"): "بدر جابر رشيد سليم طلال عدنان فيصل منذر".split(),
    ("f", "cjk"): "美玲 雅婷 淑芬 佳慧 静怡 丽娟 秀英 晓燕".split(),
    ("m", "cjk"): "志明 建国 俊杰 家豪 国强 文斌 宏伟 永康".split(),
}
SYLLABLES = {
    "latin": "ber car den far gal hol kem lin mar nor pel quin ros stan tor ul ver wes yor zan".split(),
    "cyrillic": "бер вол гор дам зор кар лен мир нов пет рос сок тим фед хар шев".split(),
    "greek": "βερ γαλ δαμ ζορ καρ λεν μιρ νικ παπ ρος σταμ τιμ φωτ χαρ".split(),
    "arabic": "بدر جبر حمد رشد سلم طلع عدن فهد قسم منذ نصر وهب".split(),
    "cjk": "欧阳 上官 司马 东方 诸葛 尉迟 公孙 慕容 令狐 宇文 长孙 夏侯".split(),
}
# For finding only, apart from what replaces: given names, titles, and family names that stand before an honorific.
KNOWN = {
    "f": (
        "Abigail Adriana Agnes Aisha Alexandra Alicia Alison Amanda Amy Ana Andrea Angela Anita Anna Anne Annette Antonia Astrid Beatrice Beatriz Bettina Birgit Brenda Brigitte Camille Carla Carmen Carol Carolina Caroline Catherine Cecilia Chantal Chiara Chloe Christina Claire Clara Claudia Cynthia Daniela Deborah Debra Denise Diana Donna Dorothy Edith Elena Elisa Elisabeth Emily Emma Erika Esther Eva Evelyn Fatima Fiona Frida Gabriele Gertrud Gisela Giulia Gloria Greta Hanna Heather Heidi Heike Helen Helena Helga Ingrid Irene Irina Isabel Jacqueline Jana Jane Janet Janice Jean Jennifer Jessica Joan Joanna Josefina Joyce Juana Judith Julia Julie Jutta Karen Karin Katarzyna Kathleen Katherine Katja Kelly Kimberly Kristin Laura Lauren Leila Leticia Linda Lisa Lucia Lucy Luisa Magdalena Marcela Margarita Maria María Marie Marina Marion Marta Martha Martina Mary Megan Melanie Melissa Michelle Monica Monika Monique Nancy Natalia Natalie Nathalie Nicole Nina Noor Olga Olivia Pamela Paola Paula Pauline Petra Rachel Raquel Renate Rita Roberta Rosa Ruth Sabine Samantha Sandra Sara Sarah Sharon Shirley Silvia Simone Sofia Sonia Sophie Stefanie Stephanie Susan Sylvia Tamara Tanja Teresa Theresa Ursula Ute Valentina Valerie Vanessa Wendy Yolanda Yvonne Zainab Zoe "
        "Александра Алина Алла Анна Валерия Вера Галина Дарья Евгения Елена Елизавета Зинаида Инна Ирина Кристина Ксения Лариса Любовь Марина Мария Наталья Нина Оксана Ольга Полина Раиса София Тамара Юлия Яна "
        "Άννα Αγγελική Αικατερίνη Αναστασία Γεωργία Ειρήνη Ελένη Ελευθερία Ιωάννα Κατερίνα Κωνσταντίνα Μαρία Παναγιώτα Σοφία Χριστίνα فاطمة عائشة خديجة زينب مريم ليلى سارة هدى أمينة نورة سميرة"
    ),
    "m": (
        "Aaron Adam Adrian Ahmed Alan Albert Alberto Alejandro Alessandro Alexandre Alfred Ali Álvaro Andreas Andrew André Antoine Antonio Arnold Arthur Bernard Bernd Bernhard Brandon Brian Bruno Bryan Carl Carlos Charles Christoph Claude Daniel David Dennis Diego Dieter Dietmar Dirk Dmitri Donald Douglas Eduardo Emil Emmanuel Enrique Eric Erik Ernst Eugene Fabian Felipe Felix Fernando Francesco Francisco François Franz Friedrich Gary Georg George Gerald Gerhard Giovanni Giuseppe Gregory Guido Günter Günther Gustav Hans Harald Harold Hassan Heinrich Heinz Helmut Henri Henry Herbert Hermann Hugo Ian Ibrahim Igor Ivan Jacob Jacques Jakob James Jan Javier Jean-Pierre Jeffrey Jens Jeremy Jerome Jesús Joachim Johann Johannes John Jonas Jorge José Jose Josef Joseph Joshua Juan Julian Jürgen Justin Kai Karl Keith Kenneth Kevin Klaus Kurt Larry Lars Laurent Lawrence Louis Luca Lucas Ludwig Luigi Luis Lukas Magnus Manfred Manuel Marc Marcel Marco Marcus Mario Markus Martin Mateo Matteo Matthew Matthias Maurice Michael Michel Miguel Mohamed Mohammed Mohammad Moritz Muhammad Mustafa Nathan Niels Nikolai Norbert Olaf Oliver Omar Oscar Otto Pablo Paolo Pascal Paul Pedro Peter Philip Philipp Philippe Pierre Rafael Rainer Ralf Ralph Ramón Raúl Reinhard René Ricardo Richard Robert Roberto Rodrigo Roger Roland Rolf Ronald Rudolf Russell Ryan Salvatore Samuel Sandro Scott Sean Sergei Sergio Simon Stefan Stefano Stephen Steven Sven Terry Thomas Thorsten Timothy Tobias Todd Tomás Torsten Udo Ulrich Uwe Victor Viktor Vladimir Walter Werner Wilhelm Wolfgang Xavier Yusuf Yves "
        "Алексей Анатолий Андрей Антон Аркадий Артём Борис Вадим Валентин Валерий Василий Виктор Виталий Вячеслав Геннадий Георгий Григорий Даниил Денис Евгений Егор Иван Игорь Илья Кирилл Леонид Максим Никита Олег Павел Пётр Роман Руслан Семён Сергей Степан Фёдор Юрий Ярослав "
        "Αλέξανδρος Ανδρέας Αντώνης Απόστολος Γεώργιος Γιάννης Γιώργος Δημήτρης Δημήτριος Ηλίας Ιωάννης Κωνσταντίνος Κώστας Μιχάλης Νικόλαος Νίκος Παύλος Πέτρος Σπύρος Χρήστος محمد أحمد علي حسن حسين عمر خالد يوسف إبراهيم محمود مصطفى عبدالله سعيد كريم طارق"
    ),
}
HAN = "欧阳 司马 上官 诸葛 王 李 张 張 刘 劉 陈 陳 杨 楊 赵 趙 黄 黃 周 吴 吳 徐 孙 孫 胡 朱 高 林 何 郭 马 馬 罗 羅 梁 宋 郑 鄭 谢 謝 韩 韓 唐 冯 馮 于 董 萧 蕭 程 曹 袁 邓 鄧 许 許 傅 沈 曾 彭 吕 呂 苏 蘇 卢 盧 蒋 蔣 蔡 贾 賈 丁 魏 薛 叶 葉 阎 余 潘 杜 戴 夏 钟 鍾 汪 田 任 姜 范 方 石 姚 谭 譚 廖 邹 鄒 熊 金 陆 陸 郝 孔 白 崔 康 毛 邱 秦 江 史 顾 顧 侯 邵 孟 龙 龍 万 萬 段 雷 钱 錢 汤 湯 尹 黎 易 常 武 乔 喬 贺 賀 赖 賴 龚 龔 文".split()
HONORIFICS = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "夫人": "f"}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f"} | {
    **dict.fromkeys("Sir Lord Monsignor Signor Sig Don Senhor Meneer Pan Sr Brother Father Κύριος Κος السيد الأستاذ".split(), "m"),
    **dict.fromkeys("Lady Dame Madam Mademoiselle Mme Mlle Signora Signorina Doña Senhora Mevrouw Fräulein Pani Sra Κυρία Κα السيدة الآنسة".split(), "f"),
    **dict.fromkeys("Dr Doctor Doktor Prof Professor Professeur Mx Rev Reverend Judge Senator Доктор Профессор Δρ Καθηγητής الدكتور الدكتورة".split(), "n"),
}
COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE"

_GENDER = {name: g for (g, script), names in GIVEN.items() if script != "cjk" for name in names} | {name: g for g, names in KNOWN.items() for name in names.split()}


def _any(words) -> str:
    """A pattern of any of ``words``, as a trie: its time doesn't grow with their number."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    some = [re.escape(c) + (_any(rest) if rest != [""] else "") for c, rest in sorted(heads.items()) if c]
    return (f"(?:{'|'.join(some)})" + "?" * ("" in heads)) if len(some) > 1 or "" in heads else some[0]


_TITLE, _KNOWN = _any(TITLES), _any(_GENDER)
_HONORED = rf"(?:{'|'.join(HAN)})[\u4e00-\u9fff]{{0,2}}?(?:{'|'.join(HONORIFICS)})"
_NAME = r"[^\W\d_a-zà-öø-ÿа-я][^\W\d_]+(?:-[^\W\d_]+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PATTERNS = [
    ("email", r"(?<![\w.%+-])[\w.%+-]*[\w%+-]@(?:[\w-]+\.)+[A-Za-z]{2,}"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b[\"']?[ \t]*[=:][ \t]*[\"']?)(?P<secret>(?=[_+/.-]*[A-Za-z0-9])[A-Za-z0-9_+/.-]{8,}[A-Za-z0-9_+/-])|\b(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{16})\b"),
    ("iban", rf"\b(?:{'|'.join(COUNTRIES.split())})\d\d(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b"),
    ("ip", rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"),
    ("card", r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])"),
    ("title", rf"\b(?P<title>{_TITLE})\b\.?(?: {_TITLE}\b\.?)* (?P<names>{_NAME}(?: {_NAME})?)"),
    ("name", rf"\b(?P<given>{_KNOWN}) (?P<family>{_NAME})"),
    ("honored", _HONORED),
]
_ENTITY = re.compile("|".join(f"(?P<k_{kind}>{pattern})" for kind, pattern in _PATTERNS))
#: No entity lacks all of these.
_HINT = re.compile(rf"[0-9@]|[=:]|\b{_any([*TITLES, *_GENDER])}\b|{'|'.join(HONORIFICS)}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_rest(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def script_of(name: str) -> str:
    for script, letters in (("cyrillic", "[Ѐ-ӿ]"), ("greek", "[Ͱ-Ͽἀ-῿]"), ("arabic", "[\u0600-\u06ff]"), ("cjk", "[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")):
        if re.search(letters, name):
            return script
    return "latin"


def _bare(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` and the other mentions of its names, whole words as they are or in capitals."""
    names: dict[str, tuple[str, str]] = {}
    # A name is worn as the family name it was found as, else as the given name.
    for _, _, kind, entity in sorted((m for m in found if m[2].startswith(("given", "family"))), key=lambda m: (m[2][0] != "f", m[0])):
        if len(entity) > 1:
            names.setdefault(entity, (kind, entity))
    for entity, told in list(names.items()):
        names.setdefault(entity.upper(), told)
    if not names:
        return found
    # Words of scripts without spaces have no ends to look for.
    free = [n for n in names if script_of(n) == "cjk"]
    whole = [n for n in names if script_of(n) != "cjk"]
    looked = re.compile("|".join([*([rf"(?<!\w){_any(whole)}(?!\w)"] if whole else []), *map(re.escape, sorted(free, key=len, reverse=True))]))
    out, k = [], 0
    for x in looked.finditer(text):
        while k < len(found) and found[k][1] <= x.start():
            out.append(found[k])
            k += 1
        if k == len(found) or x.end() <= found[k][0]:
            out.append((x.start(), x.end(), *names[x.group()]))
    return out + found[k:]


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) in order, not overlapping; entity is what coreferent mentions share.

    Kinds end in their shape's fixed part where one is to be kept: a name's gender and script.
    """
    if not text or not _HINT.search(text):
        return []
    out, at = [], 0
    while m := _ENTITY.search(text, at):
        (s, e), own = m.span(), []
        kind = next(k for k, _ in _PATTERNS if m.group(f"k_{k}") is not None)
        if kind == "secret":
            which = "secret" if m.group("secret") else "aws"
            own = [(*m.span(which), "secret", m.group(which))]
        elif kind == "card":
            digits = re.sub(r"\D", "", m.group())
            own = [(s, e, "card", digits)] if luhn(digits) else []
        elif kind == "iban":
            plain = m.group().replace(" ", "")
            own = [(s, e, "iban", plain)] if 15 <= len(plain) <= 34 and iban_rest(plain) == 1 else []
        elif kind == "phone":
            digits = re.sub(r"\D", "", m.group())
            own = [(s, e, "phone", ("+" if m.group()[0] == "+" else "") + digits)] if 8 <= len(digits) <= 15 else []
        elif kind == "honored":
            title = m.group()[-2:]
            plain = m.group()[:-2]
            family = next(h for h in HAN if plain.startswith(h))
            own = [(s, s + len(family), "family-cjk", family)]
            if plain != family:
                own.append((s + len(family), e - 2, f"given-{HONORIFICS[title]}-cjk", plain[len(family) :]))
        elif kind in ("title", "name"):
            if kind == "title":
                b, parts, gender = m.start("names"), m.group("names").split(" "), TITLES[m.group("title")]
            else:
                b, parts, gender = s, m.group().split(" "), _GENDER[m.group("given")]
            for k, part in enumerate(parts):
                role = "family" if k == len(parts) - 1 else f"given-{_GENDER.get(part, gender)}"
                own.append((b, b + len(part), f"{role}-{script_of(part)}", part))
                b += len(part) + 1
        else:
            own = [(s, e, kind, m.group().lower() if kind == "email" else m.group())]
        out += own
        at = own[-1][1] if own else s + max(1, len(m.group()) if kind not in ("card", "phone", "iban") else 1)
    return _bare(text, out)


class Draw:
    """A stream of numbers keyed by what is to be replaced and how often it was tried."""

    def __init__(self, key: str, kind: str, entity: str, attempt: int):
        self.key, self.seed = key.encode(), f"{kind}\0{entity}\0{attempt}".encode()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.digest(self.key, self.seed + self.block.to_bytes(4, "big"), "sha256")
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def pick(self, values):
        return values[self.below(len(values))]

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case (hex stays hex), the rest as it is."""
        hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and not text.isalpha() and not text.isdigit()
        out = []
        for c in text:
            if hexed and c.isalnum():
                x = self.pick("0123456789abcdef")
                out.append(x.upper() if text.isupper() else x)
            elif c in "0123456789":
                out.append(self.pick("0123456789"))
            elif "a" <= c <= "z":
                out.append(self.pick("abcdefghijklmnopqrstuvwxyz"))
            elif "A" <= c <= "Z":
                out.append(self.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            elif c.isalpha():
                x = self.pick(SYLLABLES[script_of(c)])[0]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: str, kind: str, entity: str, attempt: int) -> str:
    """The replacement in the entity's plain form (see ``worn`` for a mention's own form).

    Later attempts draw from ever more values: longer local parts, secrets and names, and, after
    many, a tail of digits on what has a fixed shape. So no set of entities is too large.
    """
    draw = Draw(key, kind, entity, attempt)
    if attempt >= 40 and kind in ("ip", "card", "iban", "phone", "ssn"):
        tail = "".join(draw.pick("0123456789") for _ in range(attempt // 4 - 8))
        return surrogate(key, kind, entity, attempt % 40) + ("" if kind in ("card", "iban", "phone") else "-") + tail
    more = "".join(draw.pick("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(attempt // 4))
    if kind == "domain":
        *labels, top = entity.split(".")
        return ".".join([*(draw.like(x) for x in labels[:-1]), draw.like(labels[-1]) + more, top])
    if kind == "mailbox":  # of its own domain's mailboxes; see ``assign``
        local, domain = entity.rsplit("@", 1)
        return f"{draw.like(local)}{more}@{domain}"
    if kind == "email":  # by itself; ``assign`` lets its domain draw again
        local, domain = entity.rsplit("@", 1)
        return f"{draw.like(local)}{more}@{surrogate(key, 'domain', domain, 0)}"
    if kind == "secret":
        fixed = entity[:4] if entity[:4] in ("AKIA", "ASIA") else ""
        rest = entity[len(fixed) :]
        return fixed + ("".join(draw.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in rest) if fixed else draw.like(rest)) + more
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        body = entity[0] + "".join(draw.pick("0123456789") for _ in entity[1:-1])
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "iban":
        body = draw.like(entity[4:])
        return f"{entity[:2]}{98 - iban_rest(entity[:2] + '00' + body):02d}{body}"
    if kind == "phone":
        keep = 2 if entity[0] == "+" else 0  # the plus sign and the country code's first digit
        return entity[:keep] + "".join(draw.pick("23456789" if k == 0 else "0123456789") for k in range(len(entity) - keep))
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}-{1 + draw.below(99):02d}-{1 + draw.below(9999):04d}"
    role, *shape = kind.split("-")
    if role == "given":
        # A title without a gender leaves the name's open.
        names = [n for g in ("fm" if shape[0] == "n" else shape[0]) for n in GIVEN[g, shape[1]]]
        # The list first; later tries are double names, so that it never runs out.
        return draw.pick(names) if attempt < 4 else "-".join(draw.pick(names) for _ in range(2 + attempt // 8))
    made = "".join(draw.pick(SYLLABLES[shape[0]]) for _ in range(3 + attempt // 8))
    return made.upper() if entity.isupper() else made.capitalize()


def worn(kind: str, mention: str, plain: str) -> str:
    """``plain`` with the separators and the case of ``mention``."""
    if kind in ("card", "phone", "iban"):
        rest = iter(plain)
        return "".join([*(next(rest) if c.isalnum() or c == "+" else c for c in mention), *rest])
    if kind == "email" or kind.startswith(("given", "family")) and len(mention) > 1:
        return plain.upper() if mention.isupper() else plain
    return plain


def _drawn(df: DataFrame, key: str) -> DataFrame:
    """``df`` (kind, entity, attempt) and what each draws, plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, entity, attempt = (c.to_pylist() for c in batch.columns)
            made = [surrogate(key, k, e, a) for k, e, a in zip(kind, entity, attempt)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "entity", "attempt", "plain"])

    return df.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, plain string")


def assign(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, plain): a replacement for each distinct entity of ``found`` (kind, entity).

    An email's mailbox and domain draw apart: domains settle among all domains, mailboxes among
    those of their own domain. In each round what was drawn must be no entity that occurs and
    nobody's replacement yet; of those that drew the same in one round the one with the least
    entity keeps it, and the others draw again. Only they and what they drew are looked at in the
    next round. The values to draw from grow with the attempts (see ``surrogate``), so the rounds
    end for any entities. Only pairs of strings move; no group of them is gathered.
    """
    known = found.select("kind", "entity").distinct()
    mail, domain = F.col("kind") == "email", F.substring_index("entity", "@", -1)
    # Its domain and its mailbox are entities beside what else was found.
    known = cut(
        known.select(F.when(mail, "mailbox").otherwise(F.col("kind")).alias("kind"), "entity")
        .unionByName(known.where(mail).select(F.lit("domain").alias("kind"), domain.alias("entity")).distinct())
    )
    taken = known.select("kind", F.col("entity").alias("plain"))
    open_, settled = known.withColumn("attempt", F.lit(0)), []
    while True:
        drew = cut(_drawn(open_, key))
        occupied = taken
        for part in settled:
            occupied = occupied.unionByName(part.select("kind", "plain"))
        blocked = occupied.join(drew.select("kind", "plain").distinct(), ["kind", "plain"])
        free = drew.join(blocked, ["kind", "plain"], "left_anti")
        kept = cut(free.groupBy("kind", "plain").agg(F.min("entity").alias("entity")))
        settled.append(kept)
        open_ = cut(drew.join(kept, ["kind", "entity"], "left_anti").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")))
        if open_.isEmpty():
            break
    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part)
    boxes = whole.where("kind = 'mailbox'").select("entity", domain.alias("domain"), F.substring_index("plain", "@", 1).alias("box"))
    houses = whole.where("kind = 'domain'").select(F.col("entity").alias("domain"), F.col("plain").alias("house"))
    mails = boxes.join(houses, "domain").select(F.lit("email").alias("kind"), "entity", F.concat_ws("@", "box", "house").alias("plain"))
    return whole.where("kind NOT IN ('mailbox', 'domain')").select("kind", "entity", "plain").unionByName(mails)


def replace(docs: DataFrame, key: str = KEY, kinds: str | None = "pii") -> DataFrame:
    """``docs``, all its columns, with entities of ``text`` replaced, then ``kinds`` array<string>.

    The last column lists the kinds found, one for each mention; a column of ``docs`` by its name
    goes. With None there is none, and all columns stay. Rows without entities are untouched
    (null and empty texts among them); n_chars, if there, follows the text. Repeated rows are
    treated alike, each for itself.
    """
    if kinds is not None:
        docs = docs.drop(*[c for c in docs.columns if c.lower() == kinds.lower()])
    schema, names = docs.schema, docs.columns
    at = names.index("text")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("entity", pa.string())])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": s, "end": e, "kind": k, "entity": v} for s, e, k, v in entities(t)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema)), pa.array(found, pa.list_(span))], names=["row", "spans"])

    spans = T._parse_datatype_string("spans array<struct<start: int, end: int, kind: string, entity: string>>").fields
    seen = docs.mapInArrow(detect, T.StructType([T.StructField("row", schema), *spans]))
    # Of written rows the number stays the same, however often they are read.
    seen = written(seen.withColumn("at", F.monotonically_increasing_id()), "pii")
    mentions = seen.where(F.size("spans") > 0).select("at", F.explode("spans").alias("m")).select("at", "m.start", "m.kind", "m.entity")
    told = mentions.join(assign(mentions, key), ["kind", "entity"]).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", "plain"))).alias("plains"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, marks, plain = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            columns = row.flatten()
            texts, found = [], []
            for text, own, new in zip(columns[at].to_pylist(), marks, plain):
                parts, done = [], 0
                for m, p in zip(own, new):
                    parts += [text[done : m["start"]], worn(m["kind"], text[m["start"] : m["end"]], p["plain"])]
                    done = m["end"]
                texts.append("".join([*parts, text[done:]]))
                found.append([m["kind"].split("-")[0] for m in own])
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) for t in texts], columns[k].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(row.type)), pa.array(found, pa.list_(pa.string()))], names=["row", "found"])

    out = T.StructType([T.StructField("row", schema), T.StructField("found", T.ArrayType(T.StringType()))])
    changed = seen.where(F.size("spans") > 0).join(told, "at").select("row", "spans", "plains").mapInArrow(rewrite, out)
    same = seen.where(F.size("spans") == 0).select("row", F.array().cast("array<string>").alias("found"))
    whole = same.unionByName(changed)
    return whole.select(*[F.col("row").getField(c).alias(c) for c in names], *([F.col("found").alias(kinds)] if kinds is not None else []))
