"""Structural chunks of Java sources, and windows of prose."""

from plumbline.operators import chunks

SHELF = """package shop.stock;

public final class Shelf {
    protected int width = 3;

    public Shelf(int width) {
        this.width = Math.max(width, 1);
    }

    int free(java.util.List<Integer> used) {
        int left = width;
        while (!used.isEmpty()) {
            left -= used.remove(0);
        }
        return left;
    }

    static class Row {
        long cells() {
            return 7L;
        }
    }
}
"""
MANY = '''/* class No { */
package a.b;
import java.util.*;
// interface Neither { void x(); }
@Entity(name = "x{", tags = {"a", "b"})
public abstract class Big<T extends Comparable<T>> extends Base implements One, Two {
    static final int[] SIZES = {1, 2, 3};
    private Map<String, List<T>> byKey = new HashMap<>() {{
        put("}", null);
    }};
    private final Runnable task = () -> { run(); };
    char brace = '{'; String text = """
        class Hidden { ' " }
        """;
    static { System.out.println("{"); }
    { init(); }
    @Override @SuppressWarnings({"unchecked", "x(y)"})
    public <R> R map(Function<? super T, ? extends R> f, @Named("(") int... n) throws IOException {
        class Local { void inside() { } }
        return new Thing() { void anonymous() { } }.get();
    }
    protected abstract void later(int a);
    enum Colour implements Coded { RED("r") { int code() { return 1; } }, GREEN(";"); private final String c;
        Colour(String c) { this.c = c; } int code() { return 0; } }
    record Point(int x, int y) { Point { check(x); } static Point of() { return null; } double norm() { return 0; } }
    interface Shape { double area(); default int sides() { return 0; } class Deep { } }
    @interface Marked { String value() default "{"; int n() default 1; }
}
class Second { }
enum Bare { A, B }
'''


def symbols(source):
    return [(c[0], c[1]) for c in chunks.java_chunks(source)]


def test_heads_methods_and_nested_types():
    found = chunks.java_chunks(SHELF)
    assert [c[:4] for c in found] == [
        ("shop.stock.Shelf", "CLASS", 3, 23), ("shop.stock.Shelf#<init>", "METHOD", 6, 8), ("shop.stock.Shelf#free", "METHOD", 10, 16),
        ("shop.stock.Shelf$Row", "CLASS", 18, 22), ("shop.stock.Shelf$Row#cells", "METHOD", 19, 21),
    ]
    assert found[0][4] == "public final class Shelf {\n    protected int width = 3;\n}"
    assert found[2][4].startswith("int free(java.util.List<Integer> used) {\n    int left") and found[2][4].endswith("return left;\n}")
    assert "protected" not in found[2][4] and found[3][4] == "static class Row {\n}"


def test_all_kinds_of_declarations():
    big = "a.b.Big"
    assert symbols(MANY) == [
        (big, "CLASS"), (f"{big}#map", "METHOD"), (f"{big}#later", "METHOD"), (f"{big}$Colour", "CLASS"), (f"{big}$Colour#<init>", "METHOD"), (f"{big}$Colour#code", "METHOD"),
        (f"{big}$Point", "CLASS"), (f"{big}$Point#<init>", "METHOD"), (f"{big}$Point#of", "METHOD"), (f"{big}$Point#norm", "METHOD"),
        (f"{big}$Shape", "CLASS"), (f"{big}$Shape#area", "METHOD"), (f"{big}$Shape#sides", "METHOD"), (f"{big}$Shape$Deep", "CLASS"), (f"{big}$Marked", "CLASS"),
        ("a.b.Second", "CLASS"), ("a.b.Bare", "CLASS"),
    ]
    head = chunks.java_chunks(MANY)[0]
    assert head[4].startswith("public abstract class Big {\n") and all(x in head[4] for x in ("SIZES = {1, 2, 3};", "byKey", "task = ", "char brace = '{';", "class Hidden"))
    assert not any(x in head[4] for x in ("println", "init()", "Colour", "later"))


def test_sources_without_types_and_broken_ones(spark):
    assert symbols("") == symbols("package a; import b.C;") == symbols("just some words, no code at all") == []
    rows = [("a", SHELF), ("b", "class Torn { int f( { } }"), ("c", None), ("d", "class A { void m() { }"), ("e", "class A { } }"), ("f", MANY), ("f", "class F { }")]
    found = chunks.structural(spark.createDataFrame(rows, "path string, content string").repartition(3)).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r["path"], r["n"])):
        by.setdefault(r["path"], []).append((r["symbol"], r["kind"]))
    assert by["a"] == symbols(SHELF) and by["b"] == by["d"] == by["e"] == [(None, "BROKEN")] and "c" not in by and len(by["f"]) == len(symbols(MANY)) + 1


def test_a_source_of_a_megabyte():
    source = "class Long {\n" + "".join(f"    int m{i}(int a) {{ if (a > {i}) {{ return \"}}\".length(); }} return a; }}\n" for i in range(15_000)) + "}\n"
    found = chunks.java_chunks(source)
    assert len(source) > 1_000_000 and len(found) == 15_001 and found[-1][0] == "Long#m14999" and found[-1][2] == 15_001


def test_brackets_are_counted_out_only_where_they_are_deep(spark, monkeypatch):
    deep = "class Deep {\n  void m() " + "{ f(" * 9 + ") }" * 9 + "\n  int[] a = {1, 2}, b = g(() -> {{ ((0)); }});\n  class Deeper { void n() { } }\n}\n"
    assert symbols(deep) == [("Deep", "CLASS"), ("Deep#m", "METHOD"), ("Deep$Deeper", "CLASS"), ("Deep$Deeper#n", "METHOD")]
    assert chunks.java_chunks(deep)[0][4] == "class Deep {\n    int[] a = {1, 2}, b = g(() -> {{ ((0)); }});\n}"
    want = [chunks.java_chunks(x) for x in (SHELF, MANY)]
    counted = []
    monkeypatch.setattr(chunks, "_closed", lambda code, at, closed=chunks._closed: (counted.append(at), closed(code, at))[1])
    assert [chunks.java_chunks(x) for x in (SHELF, MANY)] == want and not counted
    assert symbols(deep) and counted
    files = spark.createDataFrame([("a", SHELF), ("b", None), ("c", "class Torn {"), ("d", MANY)], "path string, content string")
    bare = chunks.structural(files, contents=False)
    assert bare.columns == ["path", "n", "symbol", "kind", "start_line", "end_line"]
    assert sorted(map(tuple, bare.collect()), key=str) == sorted((tuple(r)[:-1] for r in chunks.structural(files).collect()), key=str)


def test_windows(spark):
    texts = ["", None, "é" * 9, "ab🙂" * 4, "x" * 10, "y" * 13, "z" * 14, "w" * 1000 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((10, 3), (10, 0), (10, 8)):
        want = []
        for i, t in enumerate(texts):
            at = 0
            while t and (at == 0 or at + overlap < len(t)):
                want.append((i, at // (size - overlap), at, t[at : at + size]))
                at += size - overlap
        assert sorted(map(tuple, chunks.windows(df, size=size, overlap=overlap).collect())) == want
