"""Main text by density: names weigh, but decide nothing alone; several templates; cost that grows with the page."""

import time

import pytest

from corvid.llm import html_text

P = "The town council met on Tuesday to talk about the bridge, which has been closed since March, and decided to mend it before winter comes."
Q = "Work on the eastern pier starts next week; buses will use the old ferry road until the spring, as they did ten years ago."
COMMENT = "I do not agree at all with what the council did here, my friends, it is a shame and nothing more."
CASES = {
    "teaser, story and links in main": (f"<body><main><div class=teaser><a href=/b>Buy our stuff</a> one.</div><div class=story><h1>Title</h1><p>{P}</p><p>Yes.</p><p>{Q}</p></div><ul><li><a href=1>More one</a></li><li><a href=2>Two</a></li></ul></main></body>", ["Title", P, "Yes.", Q]),
    "a card beside the story": (f"<body><div id=story><h1>Title</h1><p>{P}</p><p>{Q}</p><p>Short.</p></div><article class=card><p>Another story.</p></article></body>", ["Title", P, Q, "Short."]),
    "a card after a story in the body": (f"<body><h1>Title</h1><p>{P}</p><p>{Q}</p><p>Short.</p><article class=card><p>Another story.</p></article></body>", ["Title", P, Q, "Short."]),
    "a name that has a boilerplate word": (f"<body><nav>x</nav><p>Hello.</p><section class='social-history'><h1>T</h1><p>{P}</p><p>{Q}</p></section></body>", ["T", P, Q]),
    "such names in an article": (f"<body><article><h1>T</h1><h2 id='related-work'>Others</h2><p class='alert-fatigue'>Nurses get used to alarms.</p><div class='form-factor'>Small boxes sell.</div><p>{P}</p></article></body>", ["T", "Others", "Nurses get used to alarms.", "Small boxes sell.", P]),
    "comments after an article": (f"<body><article><h1>T</h1><p>{P}</p><p>{Q}</p></article><div id=comments><div class=comment><p>{COMMENT}</p></div></div><div class='cookie-banner'>We use cookies to make things better for readers.</div></body>", ["T", P, Q]),
    "comments in an article": (f"<body><article><h1>T</h1><p>{P}</p><p>{Q}</p><section id=comments><article class=comment><p>{COMMENT}</p></article></section><div class=related><a href=1>One</a> <a href=2>Two</a></div></article></body>", ["T", P, Q]),
    "divs in place of paragraphs": (f"<body><div class=header><a href=/>Home</a></div><div class=content><div>{P}</div><div>Yes.</div><div>{Q}</div></div><div class=sidebar><p>Side things of note.</p></div><div class=footer>Copyright by us</div></body>", [P, "Yes.", Q]),
    "an article whose name is boilerplate": (f"<body><div class=social><h1>T</h1><p>{P}</p></div></body>", ["T", P]),
    "a page in a form": (f"<body><form><div><h1>T</h1><p>{P}</p><p>{Q}</p><input value=x></div></form></body>", ["T", P, Q]),
    "lists and tables": (f"<body><div id=content><h1>T</h1><p>{P}</p><ul><li>first thing</li><li>second <a href=x>thing</a></li></ul><table><tr><td>a</td><td>1</td></tr></table><p>{Q}</p></div></body>", ["T", P, "first thing", "second thing", "a 1", Q]),
    "an article's parts": (f"<body><article><header><h1>T</h1><p>By X</p></header><div class=body><p>{P}</p><p>{Q}</p></div><p>End.</p><footer>tags</footer></article></body>", ["T", "By X", P, Q, "End."]),
    "a short article and a longer advert": ("<body><div class=ad>Buy this now, all of you, at once.</div><article><h1>No.</h1><p><b>No.<br></article></body>", ["No.", "No."]),
}


@pytest.mark.parametrize("name", CASES)
def test_templates(name):
    html, want = CASES[name]
    assert html_text.main_text(html).split("\n\n") == want


@pytest.mark.parametrize("html", ["<div>" * 50_000, "<div>" * 8000 + "</section>" * 8000, "<b>" * 50_000 + "</i>" * 50_000, "<p>" + "<b>" * 20_000 + "<h1>x</h1>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<li>" * 50_000, "<table>" + "<tr><td>" * 30_000])
def test_cost_grows_with_the_page(html):
    def took(x):
        began = time.process_time()
        html_text.main_text(x)
        return time.process_time() - began

    # a quarter of the tags takes well over a sixteenth of the time, as a quadratic cost would not
    quarter = html[: len(html) // 4] if "</" not in html else html[: len(html) // 8] + html[-len(html) // 8 :]
    assert min(took(html) for _ in range(2)) < 9 * max(took(quarter), 0.05)
