"""Template residue and error-page text (problem 3).

Two kinds of evidence are combined for each record.

Placeholder detectors over the elements outside code segments: template slots by
the grammar of their brackets, editors' prompts, and filler.

Responses, such as messages of error, blocking, session and maintenance pages and
notices that scripts are needed: a maximum-entropy model scores the terms of every
element. It is fitted on this table: positive examples are low-information bodies
that several hosts give word for word or but for one word (figures, addresses and
paths aside) and that share no term with the slug of their address or their title;
negative examples are the elements of fuller pages. A few labelled lines, ``SEEDS``,
join them, so that a small table is judged too. A body is a response if its terms
say so together with what its hosts, slug and title say; an element of a fuller
page only if its terms are sure.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.urls import host
from attestry.llm.maxent import MaxEnt, bounded_sample, fit, hashed, list_rows
from attestry.sources.scratch import materialize

#: Bounds of the labelled sample: repeated bodies, and fuller records, the model is fitted on.
TRAINING_BODIES = 4000
TRAINING_CHUNKS = 1500

# Notations of unfilled slots in common template languages.
SLOTS = (
    r"\{\{\{?[^{}\n]{0,80}\}?\}\}",
    r"\{%[^%\n]{0,80}%\}",
    r"<%[^%\n]{0,80}%>",
    r"\[%[^%\n]{0,80}%\]",
    r"[$#]\{[\w.]{1,60}\}",
    r"\{(?:\d{1,2}|[A-Za-z]{3,}(?:[ _.-][A-Za-z]+){0,3})\}",
    r"%%[A-Za-z_]{2,40}%%",
    r"(?<![\w%])%[A-Z][A-Z_]{1,40}%(?![\w%])",
    r"##[A-Z_]{2,40}##",
    r"@@[A-Z_]{2,40}@@",
    r"\b__[A-Z][A-Z_]{1,40}__\b",
    r"\*\|[A-Z_:]{2,40}\|\*",
    r"\[\[[A-Za-z_ ]{2,40}\]\]",
    r"<<[A-Za-z_ ]{2,40}>>",
    r"\$[A-Z_]{2,40}\$",
    r"~[a-z_]{3,40}~",
    r"<(?:title|insert|your|enter|placeholder|name|date|text|headline)\b[^<>\n]{0,40}>",
    r"\[(?:insert|your|enter|add|placeholder|name|text|date)\b[^\[\]\n]{0,40}\]",
    r"\[(?:YOUR|INSERT|ENTER|ADD) [A-Z ]{2,40}\]",
    r"\bTODO(?:_[A-Z]+)+\b",
    r"(?<![\w%])%[sd](?![\w%])",
    r"<!--.{0,80}?-->",
)

# Prompts that editors and page builders leave behind.
PROMPTS = (
    r"goes here\b",
    r"click to edit",
    r"your [a-z]+ here\b",
    r"^(?:TBD|TBC|TODO|FIXME)\b",
    r"title for preview",
    r"^heading \d+$",
    r"^untitled\b",
    r"^add your (?:description|text|title|content)\b",
    r"copy to follow",
    r"lorem ipsum",
    r"(?:ihr|dein|euer) (?:text|titel|name) (?:kommt )?hier\b", r"\b(?:hier|beispiel-?|platzhalter)text (?:einfügen|eingeben)\b",
    r"votre (?:texte|titre|nom) ici\b", r"insérez (?:le|votre) (?:texte|titre)", r"\b(?:su|tu) (?:texto|título|nombre) aquí\b", r"inserte (?:el|su) (?:texto|título)",
    r"εισάγετε (?:κείμενο|τίτλο)", r"أدخل (?:النص|العنوان) هنا", r"यहाँ (?:पाठ|शीर्षक) (?:लिखें|डालें)", r"ใส่(?:ข้อความ|ชื่อ)ที่นี่",
    r"(?:在此|此处)(?:输入|填写|插入)", r"ここに(?:テキスト|文章|タイトル)を?(?:入力|挿入)",
)

# Words of filler text.
FILLER = (
    "asdf qwer zxcv foo bar baz qux blah xxxx xxx xx aaaa bbbb cccc dddd test testing 123 0 dummy copy for layout "
    "sample text placeholder paragraph goes here example words only lorem ipsum dolor sit amet"
).split()

# Endings of pseudo-Latin filler words.
PSEUDO_LATIN = r"[a-z]+(?:um|em|or|ae|at|et|it|ant|is|us|int|am|unt|ut)"

# Labelled lines, messages first, then page and article lines that use the same words.
MESSAGES = """
404 Not Found
Error 404: page not found
The page you requested could not be found on this server.
Sorry, we can't find the page you are looking for. It may have been moved or deleted.
This page doesn't exist any more
No such page at this address
HTTP status 500: internal server error
500 Internal Server Error. The server encountered an unexpected condition.
502 Bad Gateway
504 Gateway Timeout. The upstream server took too long to respond.
Error 503: Service temporarily unavailable. The server is overloaded, try again later.
403 Forbidden. You don't have permission to access this resource.
Access denied. You are not authorised to view this page.
401 Unauthorized: please sign in to view this resource
429 Too many requests. Please slow down and retry in 60 seconds.
Your session has timed out. Please log in again.
You have been logged out because of inactivity. Sign in again to continue.
We are down for maintenance. We will be back soon.
The site is undergoing scheduled maintenance.
Please verify that you are human
Checking your browser before accessing the site. This process is automatic.
Unusual traffic was detected from your network. Solve the captcha to continue.
Your request was blocked. Ray ID 0
Your IP address has been blocked by the administrator.
Something went wrong. Try reloading the page.
An unexpected error occurred while processing your request.
Fatal error: allowed memory size exhausted in x on line 0
Uncaught exception: cannot connect to the database
Error establishing a database connection
Connection to database failed: timeout after 0 ms
Warning: undefined variable in x on line 0
The requested document has been removed by its owner.
This account has been suspended
This content is not available in your region.
The requested URL was rejected.
Please enable JavaScript to continue
JavaScript is disabled in your browser. Turn it on and reload the page.
You need to allow scripts to run this application.
This site requires JavaScript and cookies to work.
Your browser does not support scripts
For full functionality it is necessary to enable JavaScript.
Loading… if nothing happens, enable scripts
Seite nicht gefunden
Die angeforderte Seite existiert nicht.
Zugriff verweigert. Bitte melden Sie sich an.
Interner Serverfehler
Der Dienst ist vorübergehend nicht verfügbar.
Wegen Wartungsarbeiten nicht erreichbar.
Ihre Sitzung ist abgelaufen.
Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.
Zu viele Anfragen
Page introuvable
La page demandée n'existe pas ou plus.
Accès refusé
Erreur interne du serveur
Service temporairement indisponible
Site en maintenance
Votre session a expiré
Veuillez activer JavaScript pour afficher cette page.
Página no encontrada
La página que busca no existe.
Acceso denegado
Error interno del servidor
Servicio no disponible temporalmente
Sitio en mantenimiento
Su sesión ha caducado
Active JavaScript para ver esta página.
Pagina non trovata
La pagina richiesta non esiste.
Accesso negato
Errore interno del server
Servizio temporaneamente non disponibile
Sito in manutenzione
La sessione è scaduta
Abilita JavaScript per visualizzare questa pagina.
Página não encontrada
A página solicitada não existe.
Acesso negado
Erro interno do servidor
Serviço temporariamente indisponível
Site em manutenção
A sua sessão expirou
Ative o JavaScript para ver esta página.
Pagina niet gevonden
De opgevraagde pagina bestaat niet.
Toegang geweigerd
Interne serverfout
De dienst is tijdelijk niet beschikbaar.
Wegens onderhoud niet bereikbaar.
Uw sessie is verlopen
Schakel JavaScript in om deze pagina te bekijken.
Страница не найдена
Запрошенная страница не существует.
Доступ запрещён
Внутренняя ошибка сервера
Сервис временно недоступен
Ведутся технические работы
Ваша сессия истекла
Включите JavaScript, чтобы просмотреть эту страницу.
Nie znaleziono strony
Dostęp zabroniony
Błąd serwera
Sesja wygasła
Włącz obsługę JavaScript, aby wyświetlić stronę.
Sidan hittades inte
Åtkomst nekad
Aktivera JavaScript för att visa sidan.
Sayfa bulunamadı
Erişim engellendi
Sunucu hatası
Bu sayfayı görüntülemek için JavaScript'i etkinleştirin.
Không tìm thấy trang
Halaman tidak ditemukan
페이지를 찾을 수 없습니다
접근이 거부되었습니다
이 페이지를 보려면 자바스크립트를 활성화하세요.
Η σελίδα δεν βρέθηκε
Δεν επιτρέπεται η πρόσβαση.
Σφάλμα διακομιστή
Η συνεδρία σας έληξε
Ενεργοποιήστε τη JavaScript για να δείτε τη σελίδα.
الصفحة غير موجودة
تم رفض الوصول
خطأ في الخادم
انتهت صلاحية الجلسة
يرجى تفعيل جافا سكريبت لعرض هذه الصفحة.
पृष्ठ नहीं मिला
पहुँच अस्वीकृत
सर्वर में त्रुटि
आपका सत्र समाप्त हो गया है।
इस पृष्ठ को देखने के लिए जावास्क्रिप्ट चालू करें।
ไม่พบหน้าที่คุณต้องการ
ไม่ได้รับอนุญาตให้เข้าถึง
เกิดข้อผิดพลาดในเซิร์ฟเวอร์
กรุณาเปิดใช้งานจาวาสคริปต์
ปิดปรับปรุงระบบ
页面不存在
找不到该页面
访问被拒绝
服务器内部错误
服务器繁忙，请稍后重试。
您的会话已过期，请重新登录。
系统维护中
请启用JavaScript后刷新页面。
お探しのページは見つかりませんでした
アクセスが拒否されました
サーバーエラーが発生しました
セッションが切れました。再度ログインしてください。
ただいまメンテナンス中です
このページを表示するにはJavaScriptを有効にしてください。
""".strip().split("\n")
PAGE_LINES = """
Access denied was the phrase of the day at the council meeting, the mayor told reporters.
The report says that 404 visitors found the old page of the register in the archive.
Error rates fell by half after the service was moved to the new building in March.
Engineers explained why the gateway failed and how the maintenance crew repaired it overnight.
She wrote that the server in the cellar was blocked by water, not by a fault in the software.
The session was closed by the chair after two hours, and the next one opens on Monday.
In this lesson we show what a script does when the browser has loaded the document.
The museum is not available for visits in winter, but the garden stays open all year.
Not found in any other valley, the plant was described by a teacher in 1874.
The permission to build the bridge was requested in spring and denied in autumn.
We use cookies to improve your visit. Accept all or manage your choices.
Subscribe to our newsletter and never miss a story
Sign in to read the full article
Log in or create an account to leave a comment
Share this page by mail or print it
Home | News | Contact | Help
Page 2 of 14
All rights reserved. Do not copy without permission.
Last updated on 4 May by the editorial desk
Report an error in this article
Die Seite wurde zuletzt im Mai geändert und von der Redaktion geprüft.
Der Zugriff auf das Archiv wurde 1996 erweitert, schrieb die Leiterin des Hauses.
La page de titre du registre montre le port et la session du conseil de 1902.
La página del libro muestra el puerto, y la sesión del consejo terminó tarde.
La pagina del libro mostra il porto e la sessione del consiglio.
Страница книги показывает старый порт и заседание совета.
この頁には港の古い写真が載っている。
The harbour in winter
Notes on the history of the mill
Children learn a programming language before they choose a subject.
The set of all numbers that divide the sum is small.
The town was refused a loan for the bridge.
A list of tools and how they are used
Contents
Figure 3: the valley seen from the tower
The library opens at nine.
He was not found guilty.
Two of the boats were lost.
What the survey shows
Der Hafen im Winter
Die Bibliothek öffnet um neun.
Le port en hiver
La bibliothèque ouvre à neuf heures.
El puerto en invierno
La biblioteca abre a las nueve.
Il porto in inverno
De haven in de winter
Гавань зимой
Το λιμάνι τον χειμώνα
الميناء في الشتاء
सर्दियों में बंदरगाह
ท่าเรือในฤดูหนาว
冬天的港口
冬の港
这一页展示了港口的旧照片和委员会的记录。
""".strip().split("\n")


_CODE = r"\[CODE\]:"
_TOKEN = re.compile(r"\d+|[฀-๿]+|[぀-ヿ㐀-鿿]+|[ऀ-ॿ]+|[^\W\d_]+")
_DENSE = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_MASKED = re.compile(r"[A-Za-z0-9_-]*(?:[./_@][A-Za-z0-9-]+)+/?")
_FILLER = frozenset(FILLER)
_LATIN_WORD = re.compile(PSEUDO_LATIN)
_LATIN = 1 << 24
_SEED_COPIES = 3
_SURE_SEED = 10.0  # log-odds by the seeds alone from which a line of a fuller page is no negative example


def _any(patterns: tuple[str, ...], flags: str = "(?iu)") -> str:
    return flags + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def elements_outside_code(text: Column, sentences: Column) -> Column:
    """The elements of a record that aren't code; a text without an array is cut at its code segments."""
    pieces = F.split(F.regexp_replace(text, _CODE + r".{0,120}?(?=(?:[)}>;]|\d|[a-z]) [A-Z\[]|$)", "\n"), "\n")
    return F.filter(
        F.when(F.size(sentences) > 0, sentences).otherwise(pieces),
        lambda s: s.isNotNull() & ~s.startswith("[CODE]") & (F.length(s) > 0),
    )


def slug_terms(url: Column) -> Column:
    """Words in the path of an address, in any script: four letters or more, two in scripts without spaces."""
    path = F.lower(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""))
    words = F.split(F.coalesce(F.try_url_decode(path), path), r"[^\p{L}\p{M}]+")
    return F.filter(words, lambda w: (F.length(w) >= 4) | ((F.length(w) >= 2) & w.rlike("[\\u0e00-\\u0e7f\\u3040-\\u30ff\\u3400-\\u9fff]")))


def _masked(body: Column) -> Column:
    """In lower case, addresses and paths as ``x``: those that a response quotes are no terms of a body."""
    return F.regexp_replace(F.lower(body), r"[a-z0-9_-]*(?:[./_@][a-z0-9-]+)+/?", "x")


def body_keys(body: Column) -> Column:
    """Hashes under which a body recurs: whole, and by halves of four words or more.

    Case, figures, addresses and paths are masked. Two bodies that differ in one
    word or name share a half.
    """
    words = F.filter(F.split(F.regexp_replace(_masked(body), r"\d+", "0"), r"\s+"), lambda w: w != "")
    n, half = F.size(words), F.floor(F.size(words) / 2).cast("int")
    parts = F.array(F.xxhash64(F.lit(0), F.array_join(words, " ")))
    halves = F.array(
        F.xxhash64(F.lit(1), F.array_join(F.slice(words, 1, half), " ")),
        F.xxhash64(F.lit(2), F.array_join(F.slice(words, half + 1, F.greatest(n - half, F.lit(0))), " ")),
    )
    return F.when(n >= 8, F.concat(parts, halves)).otherwise(parts)


def is_low(lines: Column, low_words: int) -> Column:
    """Whether a body has fewer than ``low_words`` words, two characters counting as one in scripts without spaces."""
    body = F.array_join(lines, " ")
    gaps = F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit("")))
    dense = F.regexp_count(body, F.lit("[\\u0e00-\\u0e7f\\u3040-\\u30ff\\u3400-\\u9fff]"))
    return (gaps < low_words) & (gaps + dense / 2 < low_words)


# What every text that matches one of SLOTS, or of PROMPTS, contains (the latter in lower case).
_SLOT_SIGN = r"[{<$#@~_\[]|%[%sdA-Z]|\*\||TODO"
_PROMPT_WORDS = (
    "goes here", " here", "click to edit", "title for preview", "heading", "untitled", "add your", "copy to follow", "lorem ipsum", "tbd", "tbc", "todo", "fixme",
    " hier", "einfügen", "eingeben", " ici", "insérez", "aquí", "inserte", "εισάγετε", "هنا", "यहाँ", "ที่นี่", "在此", "此处", "ここに")


def has_placeholder(lines: Column) -> Column:
    """Whether the elements hold a template slot or an editor's prompt."""
    body = F.array_join(lines, "\n")
    low = F.lower(body)
    prompt_word = F.lit(False)
    for w in _PROMPT_WORDS:
        prompt_word = prompt_word | F.contains(low, F.lit(w))
    return (body.rlike(_SLOT_SIGN) & body.rlike(_any(SLOTS, ""))) | (prompt_word & body.rlike(_any(PROMPTS, "(?im)")))


class _Kinds(dict):
    """1 for a filler word, ``_LATIN`` for a pseudo-Latin one, their sum for both."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        low = token.lower()
        kind = self[token] = (low in _FILLER) + (_LATIN if _LATIN_WORD.fullmatch(low) else 0)
        return kind


def is_filler(line: str, tokens: list[str], kinds: _Kinds) -> bool:
    """Whether nearly all of an element's words and figures, three at least, are filler words, or of five pseudo-Latin."""
    n = len(tokens)
    if n < 3:
        return False
    latin, known = divmod(sum(map(kinds.__getitem__, tokens)), _LATIN)
    if known * 10 < n * 9 and (n < 5 or latin * 10 < n * 8):
        return False
    return sum(map(len, tokens)) * 2 >= len(line)


def terms(line: str) -> list[str]:
    """Words of a line in lower case, figures as ``0``, addresses and paths as ``x``; pairs of characters in scripts without spaces."""
    out: list[str] = []
    for t in _TOKEN.findall(_MASKED.sub(" x ", line) if "." in line or "/" in line or "_" in line else line):
        if t[0].isdigit():
            out.append("0")
        elif _DENSE.match(t):
            out += [t[i : i + 2] for i in range(max(1, len(t) - 1))]
        else:
            out.append(t.lower())
    return out


def features(words: list[str]) -> list[str]:
    """Terms, their stems, neighbouring terms and the opening."""
    out = ["b", "f" + words[0] if words else "f"]
    out += ["w" + w for w in words]
    out += ["s" + w[:5] for w in words if len(w) > 5]
    out += [a + " " + b for a, b in zip(words, words[1:])]
    return out


class _Words(dict):
    """Weights of tokens as they stand, by its terms alone."""

    def __init__(self, weights: list[float]):
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) > 500_000:
            self.clear()
        words = terms(token)
        found = ["w" + w for w in words] + ["s" + w[:5] for w in words if len(w) > 5]
        s = self[token] = sum(self.weights[i] for i in hashed(found))
        return s


class Scorer:
    """Log-odds that a line is a response.

    ``screen`` weighs terms alone, which is quick; calling the scorer weighs all features.
    """

    def __init__(self, weights: list[float], words: list[float]):
        self.weights = weights
        self.words = _Words(words)
        self.bias = words[hashed(("b",))[0]]

    def screen(self, tokens: list[str]) -> float:
        return self.bias + sum(map(self.words.__getitem__, tokens))

    def __call__(self, line: str) -> float:
        return sum(self.weights[i] for i in hashed(features(terms(line))))


def fit_on(bodies: list[str], lines: list[str]) -> tuple[MaxEnt, MaxEnt]:
    """Weights of all features, and of terms alone, from response bodies and lines of fuller pages; the seeds join both."""
    good, bad = MESSAGES * _SEED_COPIES, PAGE_LINES * _SEED_COPIES
    seeds = fit([features(terms(x)) for x in good + bad], [True] * len(good) + [False] * len(bad), epochs=4).table()
    sure = Scorer(seeds, seeds)
    good += sorted({*bodies})
    bad += [x for x in sorted({*lines}) if sure(x) <= _SURE_SEED]  # a fuller page may be a response too
    good *= max(1, round(len(bad) / len(good)))
    rows, labels = [features(terms(x)) for x in good + bad], [True] * len(good) + [False] * len(bad)
    words = [["b", *(f for f in r[2:] if f[0] in "ws" and " " not in f)] for r in rows]
    return fit(rows, labels, epochs=4), fit(words, labels, epochs=4)


class _Marks(dict):
    """Numbers of the words between gaps; of each, how many tokens it has, and the sums of their kinds and weights."""

    def __init__(self, kinds: _Kinds, scorer: Scorer):
        super().__init__()
        self.kinds, self.scorer = kinds, scorer
        self.tokens, self.known, self.latin, self.weight = array("q"), array("q"), array("q"), array("d")

    def __missing__(self, word: str) -> int:
        tokens = _TOKEN.findall(word)
        latin, known = divmod(sum(map(self.kinds.__getitem__, tokens)), _LATIN)
        self.tokens.append(len(tokens))
        self.known.append(known)
        self.latin.append(latin)
        self.weight.append(sum(map(self.scorer.words.__getitem__, tokens)))
        out = self[word] = len(self.tokens) - 1
        return out


_BLOCK = 50_000  # lines that are looked at at once
_NEAR = 1e-6  # beyond what the order of additions changes in a sum


def doubtful(lines: list[str], marks: _Marks) -> Iterator[tuple[bool, bool]]:
    """Of each line whether ``is_filler`` may hold for it, and whether ``Scorer.screen`` may be positive; as no token goes beyond a gap, words decide."""
    for start in range(0, len(lines), _BLOCK):
        found = [line.split() for line in lines[start : start + _BLOCK]]
        ids = np.fromiter(map(marks.__getitem__, chain.from_iterable(found)), np.int64)
        at = np.repeat(np.arange(len(found)), [len(words) for words in found])
        n, known, latin, weight = (np.bincount(at, np.array(c)[ids], len(found)) for c in (marks.tokens, marks.known, marks.latin, marks.weight))
        filler = (n >= 3) & ((known * 10 >= n * 9) | ((n >= 5) & (latin * 10 >= n * 8)))
        yield from zip(filler.tolist(), (weight + marks.scorer.bias > -_NEAR).tolist(), strict=True)


def _score_rows(weights: np.ndarray, words: np.ndarray, sure: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, kinds = Scorer(weights.tolist(), words.tolist()), _Kinds()

        marks = _Marks(kinds, scorer)

        def is_residue(line: str, several: bool, filler: bool, response: bool) -> bool:
            if not filler and not (several and response):
                return False
            tokens = _TOKEN.findall(line)
            return is_filler(line, tokens, kinds) or (several and scorer.screen(tokens) > 0 and scorer(line) > sure)

        for part in parts:
            ids, alone, low = (c.to_pylist() for c in part.columns[:3])
            lines = list_rows(part.column(3))
            if len(marks) > 500_000:
                marks = _Marks(kinds, scorer)
            may = doubtful([s for ls in lines for s in ls], marks)
            out: list[tuple] = []
            for i, a, short, ls in zip(ids, alone, low, lines, strict=True):
                several, doubts = len(ls) > 1 or not short, [*islice(may, len(ls))]
                if a or any(is_residue(s, several, *d) for s, d in zip(ls, doubts, strict=True) if d[0] or d[1]):
                    out.append((i, True, None))
                elif short and ls:
                    out.append((i, False, scorer(" ".join(ls))))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.float64()), strict=True)], ["chunk_id", "alone", "body"]
            )

    return run


def _rows(chunks: DataFrame, low_words: int) -> DataFrame:
    rows = chunks.where("chunk_id IS NOT NULL AND text <> ''").select(
        "chunk_id", F.coalesce(F.nullif(host(F.col("url")), F.lit("")), "source_id").alias("host"), "url",
        elements_outside_code(F.col("text"), F.col("sentences")).alias("lines"),
    )
    return rows.withColumn("low", is_low(F.col("lines"), low_words))


def low_bodies(rows: DataFrame) -> DataFrame:
    """Low-information bodies: ``chunk_id, host, body, keys, own``.

    ``own`` is 0 where no term of the address's slug occurs, 1 where one occurs in
    the body, 2 where one occurs in the title, the first of several elements.
    """
    body = F.array_join("lines", " ")
    slug = F.coalesce(slug_terms(F.col("url")), F.array().cast("array<string>"))
    title = F.when(F.size("lines") > 1, _masked(F.col("lines")[0]))
    own = (
        F.when(F.exists(slug, lambda w: F.contains(title, w)), 2)
        .when(F.exists(slug, lambda w: F.contains(_masked(body), w)), 1)
        .otherwise(0)
    )
    return rows.where("low").select("chunk_id", "host", body.alias("body"), body_keys(body).alias("keys"), own.alias("own"))


def shared_bodies(low: DataFrame) -> DataFrame:
    """On how many hosts a body recurs, of those on more than one: ``chunk_id, hosts``."""
    places = low.select("host", F.explode("keys").alias("key")).where("host IS NOT NULL").distinct()
    hosts = places.groupBy("key").agg(F.count("*").alias("hosts")).where("hosts > 1")
    found = low.select("chunk_id", F.explode("keys").alias("key")).join(hosts, "key")
    return found.groupBy("chunk_id").agg(F.max("hosts").alias("hosts"))


def train(rows: DataFrame, low: DataFrame, shared: DataFrame, min_hosts: int) -> tuple[MaxEnt, MaxEnt]:
    """Fit on at most ``TRAINING_BODIES`` repeated bodies and the elements of ``TRAINING_CHUNKS`` fuller records."""
    often = shared.where(F.col("hosts") >= min_hosts).select("chunk_id")
    bodies = low.where("own = 0").join(often, "chunk_id", "left_semi").groupBy(F.element_at("keys", 1).alias("key")).agg(F.min("body").alias("body"))
    n_fuller = rows.select("chunk_id").count() - low.count()  # ``low`` is never null
    good = [r.body for r in bounded_sample(bodies, "key", TRAINING_BODIES)]
    bad = [s for r in bounded_sample(rows, "chunk_id", TRAINING_CHUNKS, "NOT low", n_fuller) for s in r.lines]
    return fit_on(good, bad)


def residue_evidence(chunks: DataFrame, low_words: int = 40, min_hosts: int = 3, sure: float = 8.0) -> DataFrame:
    """What speaks for residue: ``chunk_id, alone, body, hosts, own``.

    ``alone``: a detector, or an element whose terms are sure, suffices; ``body``:
    log-odds of the terms of a low-information body, null for others; ``hosts``:
    on how many hosts it recurs; ``own``: where a term of its slug occurs. Records of which nothing speaks are left out.
    """
    rows = _rows(chunks, low_words)
    low = materialize(low_bodies(rows), "low")
    shared = materialize(shared_bodies(low), "shared")
    model, words = train(rows, low, shared, min_hosts)
    scored = rows.select("chunk_id", has_placeholder(F.col("lines")).alias("alone"), "low", "lines").mapInArrow(
        _score_rows(model.weights, words.weights, sure), "chunk_id long, alone boolean, body double"
    )
    scored = materialize(scored, "residue")
    return scored.join(shared, "chunk_id", "left").join(low.select("chunk_id", "own").distinct(), "chunk_id", "left")


#: Log-odds that a body's hosts, and terms of its slug in body and title, add to those of its terms.
BY_HOSTS, BY_TWO_HOSTS, BY_ONE_HOST, BY_BODY, BY_TITLE = 4.0, 1.0, -1.5, -1.0, -3.0


def residue_records(chunks: DataFrame, low_words: int = 40, min_hosts: int = 3, sure: float = 8.0) -> DataFrame:
    """Records that hold residue instead of content: ``chunk_id``, each once.

    Null ids, null and empty texts are no cases. Bodies under ``low_words`` words
    are low-information bodies, for which hosts, slug and title count; ``sure`` is
    the log-odds from which the terms of one element of any record suffice.
    """
    evidence = residue_evidence(chunks, low_words, min_hosts, sure)
    hosts = F.coalesce("hosts", F.lit(0))
    by_hosts = F.when(hosts >= min_hosts, BY_HOSTS).when(hosts > 1, BY_TWO_HOSTS).otherwise(BY_ONE_HOST)
    by_slug = F.when(F.col("own") == 2, BY_TITLE).when(F.col("own") == 1, BY_BODY).otherwise(0.0)
    response = F.coalesce(F.col("body") + by_hosts + by_slug > 0, F.lit(False))
    return evidence.where(F.col("alone") | response).select("chunk_id").distinct()
