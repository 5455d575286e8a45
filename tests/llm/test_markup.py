"""Markup that breaks off or is never closed: what browsers show, in time proportional to the page."""

import textwrap
import time

import pytest

from beatframe.llm import language, licenses, maintext

BROKEN = {
    "tags": "<a " * 300_000, "quotes": "<a b=\"" * 150_000, "late end": "<a b=\"" * 150_000 + ">", "closing": "<div>" * 30_000 + "</p>" * 60_000, "comments": "<!--" * 200_000,
    "menus": "<nav " * 200_000, "data": "<![CDATA[" * 100_000, "cells": "<div><td>" + "</div>" * 100_000, "titles": "<title " * 100_000 + ">", "scripts": "<script>" * 100_000,
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_broken_pages_take_linear_time(name):
    start = time.process_time()
    maintext.Page(BROKEN[name])
    language.visible(BROKEN[name].encode())
    assert time.process_time() - start < 5


@pytest.mark.parametrize(("page", "text"), [
    ("<html><head><title>T</title><p>Hello world.", "Hello world."), ("<body><div><button>x</div><p>After", "After"), ("<div><svg><path d='x'><p>After", "After"),
    ("<div><select><option>a</div><p>After", "After"), ("<div><video>v</div><p>After", "After"), ("<head><meta charset=x>Text <b>bold</b>", "Text bold"),
    ("<head><title>a <p>b</title></head><p>c", "c"), ("<div><object>x<object>y</object>z</object><p>c</div>", "c"), ("<p>a < b <!-- c --> d", "a < b d"), ("<p>a <i title='x>y'>b</i>", "a b"),
    ("<p>one <b title=\"x>two</b> three", "one two three"), ("", ""),
])
def test_what_is_shown(page, text):
    assert maintext.extract_one(page, None) == text


def test_visible_leaves_out_what_is_closed():
    assert language.visible(b"a<nav x>b</nav >c<!-- d -->e<script>f").split() == [b"a", b"c", b"e", b"f"]
    assert language.visible(b"1 < 2 <b") == b"1 < 2 <b"


@pytest.mark.parametrize("prefix", ["", "// ", "# ", " * "])
@pytest.mark.parametrize("width", [30, 50, 72, 80])
def test_wrapped_templates_are_found(width, prefix):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            lines = textwrap.wrap(notice, width, break_long_words=False, break_on_hyphens=False)
            text = "\n".join(prefix + x for x in ["Some file of ours.", "", *lines, "", "And so on it goes."])
            found = list(scanner.scan(text))
            assert name in {f.license for f in found}, (name, notice[:40])
            best = next(f for f in found if f.license == name)
            assert best.exact or prefix == "" or best.matched >= 0.9


def test_repeated_wording_takes_linear_time():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    took = []
    for n in (4_000, 16_000):
        start = time.process_time()
        list(scanner.scan("licensed under the " * n))
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1
    many = list(scanner.scan("Released under the MIT License. " * 5_000))
    assert len(many) == 5_000 and all(f.license == "MIT" and f.exact for f in many)
