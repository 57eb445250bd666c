"""Residue: cases, look-alikes, and awkward inputs."""

import pytest

from vellumry.llm.residue import find_residue, is_residue

REAL = "The quiet reader counts the pages of each chapter before it prints them. Nobody asked for more than that, and the second pass changes nothing at all.\n\n"
LONG = "".join(f"Chapter {w} tells how the {w} press folds its sheets, and why the {w} binder waits until they are dry.\n\n" for w in "old new red blue quiet heavy narrow wide copper paper".split())
CASES = [
    "Welcome to {{ name }}, the tool by ${AUTHOR}.", "Dear [First Name here], thank you.", "Written by %AUTHOR% for __PROJECT_NAME__.", "Copyright <%= year %> [object Object].",
    "Install @@MODULE@@ first.", "This is (title goes here).", "Ask <insert name> about it.", "Version [[ version ]] by #{author}.", "By {maintainer} and {# fill in name #}.", "Made by TKTK.",
    "Write to XXXX with questions.", "Hello $FIRST_NAME$!", "Hello %(first_name)s!", "See <<title>>.", "Dear [YOUR NAME],", "A text by undefined for everyone.", "{{ page.author | default }} wrote it.",
]
NOT_CASES = [
    "Tags like `{{ name }}` are kept.", "```\n{{ name }} ${AUTHOR}\n```", "    {{ name }}\n    ${MISSING}\n\nThat was code.", "The cost is $w_{1} + \\frac{2}{k}$ here.", "See [[page_one]] and [the guide](https://x.example).",
    "The form says “[YOUR NAME]” in grey.", "The value is undefined here.", "~~~yaml\nname: ${{ matrix.name }}\n~~~", "| `${NAME}` | yes |", "<details>\n<summary>Log</summary>\n</details>",
]
BODIES = [
    "404 Not Found", "# 404\n\nThe page you were looking for does not exist.", "HTTP/1.1 503 Service Unavailable", "Home | Docs | Search\n\nAccess denied\n\n© 2030 quire docs", "Internal Server Error\n\nThe server could not complete your request.",
    "Please enable JavaScript to view this page.", "PLEASE TURN ON JAVASCRIPT TO CONTINUE.", "<noscript>JavaScript is required to use the reader.</noscript>", "请启用 JavaScript 后刷新本页。", "このページを表示するにはJavaScriptを有効にしてください。",
    "Для работы сайта включите JavaScript.", "Veuillez activer JavaScript pour lire cette page.", "Страница не найдена. Ошибка 404.", "页面未找到", "Seite nicht gefunden",
    "# Notes\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt ut labore.", "xxxxx " * 40, "blah blah blah blah blah.", "Coming soon.", "## A\n\nYour text here.\n\n## B\n\nBody copy.",
    "A sentence that means little is set here once more to fill. " * 12, "Dies ist ein Blindtext, der nur Platz füllt. " * 5, "Traceback (most recent call last):\n  File \"/srv/a_b.py\", line 3, in render\nKeyError: 'title'",
]
TALK = [
    "When the proxy returned 502 Bad Gateway, the job tried again and went on.", "Readers who block JavaScript get the plain text of every chapter.", "The sample holds lorem ipsum, and `--check` counts its 24 words.",
    "We removed the “coming soon” banner from the start page.", "Error 500 in the report was traced to split_it.toml, line 3.", "When a page is not found, the pass writes “not found” next to its link and goes on.",
    "Our glossary explains what an “internal server error” page looks like.", "A placeholder text of 330 words filled the old demo; it is gone now.", "Added a custom 403 page to the docs.",
]


#: Texts of other sites and languages, written after the phrases and never used to choose them.
HELD_OUT = [
    "Error 522: connection timed out", "The page you have requested cannot be displayed.", "HTTP Status 404 – Not Found", "Server Error in '/' Application.", "Bad Request - Invalid Hostname", "You have been logged out due to inactivity.", "We could not find that page.",
    "Sorry, this post was deleted by the person who originally posted it.", "This account is private.", "Video unavailable", "This item is out of stock.", "Your IP has been blocked.", "Too many requests. Please slow down.", "The server is temporarily unable to service your request.",
    "Unable to connect to the database.", "Access forbidden!", "La page demandée n'a pas été trouvée.", "Oups ! Cette page est introuvable.", "Diese Webseite ist nicht verfügbar.", "Die Seite konnte leider nicht gefunden werden.", "¡Vaya! No encontramos esa página.", "La página que busca ya no existe.",
    "Página não encontrada - Erro 404", "Ops! Pagina non trovata.", "Pagina niet gevonden", "Sidan finns inte längre.", "Sivua ei löydy.", "Strona nie została znaleziona.", "Požadovaná stránka neexistuje.", "A keresett oldal nem található.", "Pagina nu a fost găsită.", "Aradığınız sayfa bulunamadı.",
    "Η σελίδα δεν βρέθηκε.", "Запрашиваемая страница не найдена.", "Сторінка не існує.", "요청하신 페이지를 찾을 수 없습니다.", "お探しのページは存在しません。", "抱歉，您访问的页面不存在。", "الصفحة التي تبحث عنها غير موجودة.", "यह पृष्ठ उपलब्ध नहीं है।", "ไม่พบหน้าที่คุณกำลังมองหา", "Halaman tidak ditemukan.",
    "JavaScript must be turned on in order to use this page.", "Your browser has JavaScript disabled.", "You need JavaScript enabled to run this app.", "Ihr Browser unterstützt kein JavaScript.", "Votre navigateur ne supporte pas JavaScript.", "Necesitas habilitar JavaScript.", "Proszę włączyć JavaScript.", "Tarayıcınızda JavaScript etkin değil.",
    "Пожалуйста, включите JavaScript.", "此网站需要启用 JavaScript。", "この機能にはJavaScriptが必要です。", "Lorem ipsum dolor.", "Hodor ipsum hodor hodor.", "Content goes here", "Insert your text here.", "[Placeholder]", "Text to follow", "Site under maintenance", "Website coming soon", "Dear [First Name],",
    "Hello {first_name}!", "{{first_name}}, your order has shipped.", "Your order %ORDER_ID% has shipped.", "Regards, <YOUR NAME>", "[INSERT LOGO HERE]", "© [year] [company name]", "Welcome, ${username}", "asdf asdf asdf asdf", "test test test test test test test", "xxx xxx xxx",
]
#: More of them, written after the phrases had been extended by what the first list lacked.
HELD_OUT_2 = [
    "404: This page could not be found.", "The resource you are looking for has been removed.", "This listing has ended.", "Sorry, you have been blocked", "502 Bad Gateway nginx", "An error occurred during a connection.", "Your request could not be processed.", "Under maintenance, back shortly.",
    "This profile does not exist.", "The connection was reset.", "Cette page n'existe plus.", "Erreur 500 : erreur interne du serveur", "Diese Seite existiert nicht mehr.", "Fehler 403: Zugriff verweigert", "Esta página ya no está disponible.", "Error 404: página no encontrada", "La pagina richiesta non esiste.",
    "Siden finnes ikke.", "Tato stránka neexistuje.", "Ez az oldal nem létezik.", "Bu sayfa mevcut değil.", "Такой страницы не существует.", "このページは存在しません。", "页面不存在或已被删除", "이 페이지는 존재하지 않습니다.", "Trang bạn tìm không tồn tại.", "Enable JavaScript to view this site.",
    "This application requires JavaScript.", "Activez JavaScript dans votre navigateur.", "JavaScript è disabilitato nel browser.", "Dummy text.", "Sed ut lorem ipsum dolor sit amet.", "Zombie ipsum reversus ab viral inferno.", "Your headline here", "Hi {name}, thanks!", "Published on {{ date }} by {{ author }}",
]
#: Real short texts near such subjects.
HELD_OUT_REAL = [
    "The library is closed on Mondays.", "Turn on the lamp before you enter the archive.", "We moved the old page to the second volume.", "JavaScript and Python both treat empty strings as false.", "The server room was painted in May.", "Cookies are baked on Thursdays.", "He could not find his keys, so he walked.",
    "The video shows how sheets are folded.", "Our account of the flood fills three chapters.", "Ships that do not exist cannot sink.", "The road is under construction until spring, and buses take the bridge.", "Please try the soup; it is served again tomorrow.", "Die Seite aus Papier ist dünn.", "La página tres trata del puerto.",
    "この頁には三つの詩がある。", "这本书的页面很薄。", "Access to the tower is free for children.", "The template for the letter lies in the drawer.", "Errors in early prints are loved by collectors.", "Nothing found in the trench was older than the wall.",
]


def test_recall_on_texts_held_out():
    wrong = [t for t in HELD_OUT_REAL if is_residue(t)]
    for texts in (HELD_OUT, HELD_OUT_2):
        missed = [t for t in texts if not is_residue(t)]
        print(f"found {len(texts) - len(missed)} of {len(texts)}, wrong {wrong}, missed {missed}")
        assert len(missed) <= 0.4 * len(texts) and len(wrong) <= 1


@pytest.mark.parametrize("short,long", [("{{ %s }}", 500), ("<%%= %s %%>", 500), ("@@%s@@", 300), ("[insert %s here]", 300), ("${%s}", 300)])
def test_length_of_a_placeholder_does_not_matter(short, long):
    assert is_residue(REAL + short % ("name" * (long // 4)) + " ends here.\n\n" + REAL) and is_residue(REAL + short % "name" + " ends here.\n\n" + REAL)


@pytest.mark.parametrize("text", CASES)
def test_placeholders(text):
    assert is_residue(text) and is_residue(LONG + text + "\n\n" + REAL)


@pytest.mark.parametrize("text", NOT_CASES)
def test_examples_of_placeholders(text):
    assert not is_residue(REAL + text + "\n\n" + REAL)


def test_code_behind_a_byte_order_mark():
    assert not is_residue("\ufeff~~~yaml\nname: ${{ matrix.name }}\n~~~\n" + LONG)


@pytest.mark.parametrize("text", BODIES)
def test_bodies(text):
    assert is_residue(text)
    assert is_residue(text.replace("\n", "\r\n"))
    assert not is_residue(LONG + text[:200])


@pytest.mark.parametrize("text", TALK)
def test_talk_about_such_things(text):
    assert not is_residue(text) and not is_residue("# Notes\n\n" + text + "\n\n" + REAL)


@pytest.mark.parametrize("text", [None, "", " \n\t", "﻿", "Yes.", "No!", "It works.", "表が崩れました！", "# Overview\n\n## Options\n", "- one\n- two\n"])
def test_empty_and_short_texts_are_not(text):
    assert not is_residue(text)


def test_operator_on_awkward_rows(spark):
    rows = [(1, "404 Not Found", 0), (1, "404 Not Found", 0), (2, REAL, 0), (3, None, 0), (4, "", 0), (None, "404 Not Found", 0), (5, "lorem ipsum dolor " * 30_000, 0), (6, LONG + REAL, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, bucket int")
    assert sorted(r["doc_id"] for r in find_residue(df).collect()) == [1, 5]
    assert find_residue(df.limit(0)).count() == 0


def test_long_texts_stay_linear():
    import time

    start = time.time()
    for text in ("{{" * 30_000, "`" * 50_000, "$" * 50_000, "[[ " * 20_000, "<" * 50_000, "\"" * 50_001, "“" * 50_000, "    x\n" * 20_000, "```\n" * 10_001, "a " * 100_000, "x" * 400_000, "%a" * 30_000, "<pre>" * 5_000):
        is_residue(text)
    assert time.time() - start < 60
