"""Licence scan on runs of line breaks, comment-only lines, long holders and distances."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import licenses

BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""


def found(spark, *texts, **how):
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **how)
    return [r[0] for r in out.orderBy("doc_id").select(F.array_join("licenses", ",")).collect()]


@pytest.mark.parametrize("line", ["\n", "// \n", "\r\n", " * \r\n", " "])
def test_long_runs_of_lines_without_words(spark, line):
    run = line * 1_000_000
    assert found(spark, run, f"{run}All rights reserved.{run}") == ["", "proprietary-notice"]


def test_holders_of_any_length(spark):
    long = "The Regents of " + "a University " * 40
    assert found(spark, BSD2.format("THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), BSD2.format("ACME"), BSD2.format(long), BSD2.format("\n * ".join(long.split()))) == ["BSD-2-Clause"] * 4


def test_many_openings_without_an_end(spark):
    assert found(spark, "This software is provided by\n" * 100_000 + "\n\nAll rights reserved.") == ["proprietary-notice"]


def test_distance_is_an_argument(spark):
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The software is provided \"as is\", without warranty of any kind"]
    text = f". {'other words. ' * 800}".join(mit) + "."
    assert found(spark, text) == [""]
    assert found(spark, text, apart=None) == ["MIT"]


def test_holder_without_a_bound(spark):
    text = BSD2.format("The Regents of " + "a University " * 400)
    assert found(spark, text) == [""]
    assert found(spark, text, holder=None) == ["BSD-2-Clause"]
