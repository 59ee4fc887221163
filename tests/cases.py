"""Fixed cases: values, sources and packs with what is to be found in them."""

#: Built from parts, so that no string here looks like a key.
SAMPLES = [
    (0, "AIza" + "a" * 35), (1, "AIza" + "a" * 34), (2, "AKIA" + "A" * 16), (3, "AKIA" + "a" * 16), (4, "AKIA" + "A" * 16 + "\n"), (5, "sk_live_" + "a" * 16), (6, "sk_live_" + "a" * 15),
    (7, "x eyJ" + "a.b.c"), (8, "eyJ" + "a.b"), (9, "ghp_" + "a" * 36), (10, " ghp_" + "a" * 36), (11, "glpat-" + "a" * 20), (12, "glpat-" + "a" * 19),
]
FILES = [
    ("lib/a.dart", 'class Api {\n  // final key = "AKIA' + "D" * 16 + '";\n  void call(bool a) {\n    final first = r"AKIA' + "C" * 16 + '", second = "AKIA' + "C" * 16 + "\";\n    if (a) { send(apiToken: 'q8Zr2LmX0pVw7Tn'); }\n  }\n}\n"),
    ("lib/b.dart", "final testToken = 'q8Zr2LmX0pVw7Tn';\nfinal doc = \"\"\"it's\n ghp_\"\"\";\nfinal gh = 'ghp_" + "e" * 36 + "';\n"),
    ("lib/c.dart", ""), ("lib/d.dart", None),
]
ISSUES = [
    ("lib/a.dart", 4, 19, "AWS_ACCESS_KEY", "first", "call", 2, 1, 4), ("lib/a.dart", 4, 53, "AWS_ACCESS_KEY", "second", "call", 2, 1, 4),
    ("lib/a.dart", 5, 29, "HEUR.SECRET", "apiToken", "call", 2, 1, 4), ("lib/b.dart", 4, 12, "GITHUB_TOKEN", "gh", None, None, None, None),
]
PACK = '[{"id":"A","name":"a","pattern":"x","severity":"error","enabled":false},3,"s",{"id":"B","pattern":"y"},{"id":"A","pattern":"z"}]'
BROKEN = ["[]", '{"a":1}', '[{"id":']

SOURCES = [
    ("M1", 'void plain() {\n final k = "x";\n}'),
    ("M2", 'int branchy(bool a, bool b, bool c) {\n if (a && b) {\n return k["1"];\n } else if (c) {\n return 2;\n }\n return 3;\n}'),
    ("M3", 'String loops(List<int> xs) {\n for (final x in xs) {\n while (x > 0) {\n do { } while (x > 1);\n }\n }\n return xs.isEmpty ? "a" : "b";\n}'),
    ("M4", 'void sw(int n) {\n try {\n switch (n) {\n case 1: break;\n case 2: break;\n default: break;\n }\n } catch (e) {\n print("x");\n }\n}'),
    ("M5", 'void outer(List<int> xs) {\n xs.forEach((x) {\n if (x > 0 || x < -5) {\n print("in");\n }\n });\n final s = "out";\n}'),
    ("M6", 'class A {\n final String k;\n A.named() : k = "c" {\n print("d");\n }\n String get g => "e";\n}\nfinal top = "f";'),
]
EXPECTED = [
    ("M1", "x", "plain", 1, 0, 3), ("M2", "1", "branchy", 4, 2, 8), ("M3", "a", "loops", 5, 3, 8), ("M3", "b", "loops", 5, 3, 8), ("M4", "x", "sw", 4, 2, 11), ("M5", "in", "<anonymous>", 3, 1, 5),
    ("M5", "out", "outer", 1, 0, 8), ("M6", "c", "A.named", 1, 0, 3), ("M6", "d", "A.named", 1, 0, 3), ("M6", "e", "g", 1, 0, 1), ("M6", "f", None, None, None, None),
]
