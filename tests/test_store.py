"""The store and saved indexes under damage, without documents, and with more engines than are kept."""

import shutil

import pytest

from quillspark.plans import store as stores
from quillspark.plans.engine import Autocomplete
from quillspark.plans.store import DocumentStore
from quillspark.sources.documents import Document

DECK = ["How to build a deck", "How to build a desk", "How to build with python"]


def test_a_store_without_documents(spark):
    s = DocumentStore.open(spark, ":memory:")
    assert s.suggest("how ").count() == s.suggest_scored("how ").count() == s.inspect(["a", "b"]).count() == 0
    s.warm()
    s.add_documents([Document("How to build", "a")])
    s.warm()
    assert s.suggest_scored("how to b").columns == ["prompt_id", "rank", "text", "score"] and s.suggest_scored("how to b").count() > 0
    s.remove_document("a")
    assert s.suggest("how ").count() == 0


def test_pointers(spark, tmp_path):
    where = tmp_path / "store"
    s = DocumentStore.open(spark, str(where))
    for k in range(4):
        s.add_documents([Document(f"text {k}", str(k))])
    names = sorted(p.name for p in (where / "CURRENT").iterdir() if not p.name.startswith("."))
    assert names == ["3.json", "4.json", "5.json"]
    late = DocumentStore.open(spark, str(where))
    s.add_documents(["more"])
    with pytest.raises(OSError):  # two writers
        late.add_documents(["other"])
    assert DocumentStore.open(spark, str(where)).documents().count() == 5
    (where / "CURRENT" / "6.json").write_text('{"cut')
    (where / "CURRENT" / ".6.json.crc").unlink(missing_ok=True)
    assert DocumentStore.open(spark, str(where)).documents().count() == 4  # the one before it
    shutil.rmtree(where / "CURRENT")
    with pytest.raises(ValueError):  # never taken for a new store
        DocumentStore.open(spark, str(where))


def test_engines_are_kept_by_bytes(spark, monkeypatch):
    own = [DocumentStore.open(spark, ":memory:") for _ in range(2)]
    for k, s in enumerate(own):
        s.add_documents([*DECK, f"extra text {k}"])
    first = own[0].engine()
    first.warm()
    assert own[0].engine() is first and first._local is not None
    monkeypatch.setattr(stores, "ENGINE_BYTES", 1)
    own[1].engine()
    assert first._local is None and own[0].engine() is not first


def test_damaged_indexes(spark, tmp_path):
    def fresh(name):
        e = Autocomplete.create(spark, DECK)
        e.save(tmp_path / name)
        return tmp_path / name

    where = fresh("ix")
    copy = lambda n: shutil.copytree(where, tmp_path / n)
    gone = copy("gone")
    shutil.rmtree(gone / "context")
    with pytest.raises(FileNotFoundError):
        Autocomplete.load(spark, gone)
    cut = copy("cut")
    part = next((cut / "postings").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-20])
    short = copy("short")
    for f in list((short / "vocab").glob("*.parquet"))[1:] or (short / "vocab").glob("*.parquet"):
        f.unlink()
    changed = copy("changed")
    part = next((changed / "vocab").glob("*.parquet"))
    data = bytearray(part.read_bytes())
    data[40] ^= 255
    part.write_bytes(bytes(data))
    for bad in (cut, short, changed):
        with pytest.raises(ValueError):
            Autocomplete.load(spark, bad)
    # A save that fails half-way leaves no manifest that vouches for mixed tables.
    e = Autocomplete.create(spark, [*DECK, "and more of it"])
    e.index.tables["support"] = e.index["support"].selectExpr("*", "raise_error('stop') AS x")
    with pytest.raises(Exception, match="stop"):
        e.save(where)
    with pytest.raises(FileNotFoundError):
        Autocomplete.load(spark, where)


def test_docx_and_command_line(spark, tmp_path, capsys, monkeypatch):
    import zipfile

    from quillspark.sources.documents import from_items, read_bytes

    body = '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>How to </w:t></w:r><w:r><w:t>build</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>a deck</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    assert read_bytes("a.docx", (tmp_path / "a.docx").read_bytes()).split("\n")[0] == "How to build"
    assert "a deck" in from_items(spark, [tmp_path / "a.docx"]).first()["text"]

    from quillspark import __main__ as cli

    (tmp_path / "a.txt").write_text("\n".join(DECK))
    monkeypatch.setattr("sys.argv", ["quillspark", "build", str(tmp_path / "a.txt"), "--output", str(tmp_path / "cli")])
    cli.main()
    monkeypatch.setattr("sys.argv", ["quillspark", "suggest", "--index", str(tmp_path / "cli"), "how to bui"])
    cli.main()
    assert "how to build" in capsys.readouterr().out
