from pathlib import Path

import pytest

from sigmill.llm import licenses

from .helpers import ODD, docs

MIT = licenses.LICENSES["MIT"]


def scan(spark, rows):
    return {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}


def test_equal_but_for_form(spark):
    found = scan(spark, [
        (1, MIT), (2, "Copyright (c) 2020 Someone\n\n" + MIT.upper().replace(",", " ;")), (3, "# Copyright 1999 by A\n# All rights reserved.\n" + MIT.replace("\n\n", "\n#\n# ")),
        (4, MIT.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")), (5, MIT + " but not for you"), (6, "prose\nReleased under the MIT licence.\nmore\nLicensed under CC BY-NC 4.0."),
    ])
    assert [found[k]["license_id"] for k in range(1, 7)] == ["MIT"] * 4 + [None, None]
    assert found[6]["notices"] == "CC-BY-NC-4.0-notice,MIT-notice"
    assert len({found[k]["digest"] for k in range(1, 5)}) == 1


def test_odd_rows_and_empty(spark):
    rows = licenses.scan(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r["license_id"] is None and r["notices"] is None for r in rows)
    assert next(r for r in rows if r["doc_id"] == 1)["digest"] is None
    assert licenses.scan(docs(spark, [])).collect() == []


PUBLISHED = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not PUBLISHED.is_dir(), reason="no published texts on this machine")
def test_published_texts(spark):
    texts = {k: (PUBLISHED / f).read_text(errors="replace") for k, f in FILES.items() if (PUBLISHED / f).is_file()}
    names = list(texts)
    found = scan(spark, [(k, texts[n].replace("\n", "\r\n")) for k, n in enumerate(names)])
    assert [found[k]["license_id"] for k in range(len(names))] == names
    assert {r["license_id"] for r in licenses.scan(docs(spark, [(k, texts[n][:-300]) for k, n in enumerate(names)])).collect()} == {None}


def test_short_texts_and_clash(spark):
    names = list(licenses.LICENSES)
    found = scan(spark, [(k, "Copyright 2001 A\n" + licenses.LICENSES[n]) for k, n in enumerate(names)])
    assert [found[k]["license_id"] for k in range(len(names))] == names
    with pytest.raises(ValueError):
        licenses.scan(docs(spark, []), {"a": "Some text.", "b": "some  TEXT"})


def test_main_path_is_native(spark):
    plan = licenses.scan(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
