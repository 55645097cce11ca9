"""Families and versions of licences, each returned as itself."""

from __future__ import annotations

from gridclime.llm import license_scan

BODY = "Some words before it.\n\n{}\n\nSome words behind it."
CASES = {
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as "
        "published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "version 2 as published by the Free Software Foundation."
    ),
    "bsd-3-or-4-clause": (
        "Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0-title": "Creative Commons CC0 1.0 Universal",
    "EPL-2.0": "Licensed under the Eclipse Public License, version 2.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-3.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "MIT-condition": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
}


def test_families_and_versions(spark):
    df = spark.createDataFrame([(k, BODY.format(v)) for k, v in CASES.items()], "name string, text string")
    got = {r.name: r.license for r in license_scan.scan(df).collect()}
    assert got == {k: k for k in CASES}


def test_every_notice_is_found_as_itself(spark):
    df = spark.createDataFrame(sorted(license_scan.NOTICES.items()), "name string, text string")
    wrong = {r.name: (r.license, r.dice) for r in license_scan.scan(df).collect() if r.license != r.name}
    # a sentence split at a full stop inside it is shorter, but stays the same licence
    assert all(v and v.split("-")[:2] == k.split("-")[:2] for k, (v, _) in wrong.items()), wrong
