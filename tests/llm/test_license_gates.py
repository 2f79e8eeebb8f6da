"""No keyword stands between a rule and a text that it matches."""

import re
from itertools import product

import pytest

from symlake.llm import licenses

parser = re._parser


def samples(tree, space):
    """Some texts that a pattern matches: every branch, optional parts left out and taken, ``space`` for white space."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "NOT_LITERAL":
            more = [" "]
        elif name == "IN":
            kind, value = arg[0]
            if str(kind) == "NEGATE":
                more = [" "]
            elif str(kind) == "CATEGORY":
                more = {"CATEGORY_SPACE": [space], "CATEGORY_DIGIT": ["1"], "CATEGORY_WORD": ["a"], "CATEGORY_NOT_WORD": [" "]}[str(value)]
            else:
                more = [space if any(str(v) == "CATEGORY_SPACE" for _, v in arg) else chr(value)]
                more += [chr(v) for k, v in arg[1:] if str(k) == "LITERAL" and chr(v).isalpha()]
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            more = [t * n for n in {low, max(1, low) if high else 0} for t in samples(inner, space)]
        elif name == "SUBPATTERN":
            more = samples(arg[3], space)
        elif name == "BRANCH":
            more = [t for b in arg[1] for t in samples(b, space)]
        else:
            assert name in ("ASSERT_NOT", "ASSERT"), name
            more = [""]
        out = [a + b for a, b in product(out, dict.fromkeys(more))]
        if len(out) > 400:
            out = out[:200] + out[-200:]
    return out


@pytest.mark.parametrize("space", ["\n", "  ", " \t"])
def test_every_match_passes_its_keyword_and_a_stem(space):
    known = licenses.rules()
    stems = licenses.stems(known)
    for r in known:
        texts = [t for t in samples(parser.parse(r["pattern"]), space) if re.fullmatch(r["pattern"], t)]
        assert texts, r
        for t in texts:
            assert r["keyword"] in re.sub(r"\s+", " ", t), (r, t)
            assert any(s in t for s in stems), (r, t)


def test_broken_lines(spark):
    expected = {
        "GNU General\nPublic  License\nversion 3": {"gpl-3"}, "GNU Free\nDocumentation License 1.3": {"gfdl-1.3"},
        "Creative\nCommons Attribution 4.0": {"cc-by"}, "in the public\ndomain": {"public-domain"}, "All rights\n reserved": {"all-rights-reserved"},
        "SIL Open\nFont License 1.1": {"ofl-1.1"}, "Open Data Base\nLicense 1.0": {"odbl-1.0"}, "open\ndatabase license 1.0": {"odbl-1.0"},
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted": {"bsd"},
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee": {"isc"},
        "This software is provided 'as-is', without any express or\nimplied warranty": {"zlib"},
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy": {"mit"},
        "the unlicence": {"unlicense"}, "a simplified\nlicense": {"bsd-2-clause"},
    }
    found = licenses.scan(spark.createDataFrame(list(enumerate(expected)), "doc_id long, text string")).collect()
    texts = list(expected)
    assert {texts[r["doc_id"]]: {h["label"] for h in r["found"]} for r in found} == expected
