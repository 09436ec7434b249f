import contextlib
import json
from types import SimpleNamespace

import pytest

from askloom import web


class Page:
    """Answers like a page on which nothing was changed, a file was given and the button pressed."""

    def __init__(self, name, content, **given):
        self.file, self.given, self.shown = SimpleNamespace(name=name, getvalue=lambda: content), given, {}
        self.sidebar = self

    def title(self, text):
        self.shown["title"] = text

    def selectbox(self, label, options):
        return self.given.get(label, options[0])

    def text_input(self, label, value="", type=None):
        return self.given.get(label, value)

    def slider(self, label, least, most, default, step):
        assert least <= default <= most
        return self.given.get(label, default)

    def checkbox(self, label):
        return False

    def file_uploader(self, label, type):
        return self.file

    def button(self, label):
        return True

    def spinner(self, label):
        return contextlib.nullcontext()

    def error(self, text):
        self.shown["error"] = text

    def columns(self, n):
        return [SimpleNamespace(metric=lambda name, value: self.shown.setdefault("metrics", {}).update({name: value})) for _ in range(n)]

    def dataframe(self, df):
        self.shown["preview"] = df

    def download_button(self, label, data, name):
        self.shown[name] = data


def test_a_document_becomes_a_dataset(spark):
    page = Page("notes.txt", "A text about something. ".encode() * 200, Provider=web.PROVIDERS[-1], **{"Question key": "Q", "Pairs a chunk": 2})
    web.app(page, spark)
    records = [json.loads(x) for x in page.shown["dataset.jsonl"].splitlines()]
    assert "error" not in page.shown and set(records[0]) == {"Q", "answer", "chunk_index"}
    assert page.shown["metrics"]["Total Pairs Kept"] == len(records) and len(page.shown["preview"]) <= 20
    assert page.shown["metrics.csv"].startswith(b"chunk_index,")


@pytest.mark.parametrize("name,given", [("a.docx", {"Provider": web.PROVIDERS[-1]}), ("a.txt", {"Provider": "Google Gemini"}), ("a.txt", {"Provider": web.PROVIDERS[-1], "Overlapping characters": 1000, "Characters a chunk": 200})])
def test_failures_are_shown(spark, monkeypatch, name, given):
    monkeypatch.delenv("GEMINI_API_KEY", raising=False)
    page = Page(name, b"text", **given)
    web.app(page, spark)
    assert page.shown["error"].startswith("Failed")
