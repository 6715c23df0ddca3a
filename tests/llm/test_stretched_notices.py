from stradale.llm import licenses


def test_notices_with_words_between():
    """Regions longer than four times the template, and windows longer than its length and a quarter."""
    scan = licenses.Scanner(licenses.TEMPLATES).scan
    between = lambda n: " ".join(f"w{k}x" for k in range(n))
    core = "this is licensed under the GNU General Public License 3"
    text = f"{between(12)} work {between(9)} {core} {between(11)} version {between(12)}"
    (name, share, first, last), = scan(text.encode())
    assert name == "gpl-3.0" and share >= 0.8 and "licensed under the GNU" in text[first:last]
    notice = licenses.TEMPLATES["gpl-3.0"]
    wide = notice.replace("under", f"under {between(8)}")
    found = scan(f"{wide} and {notice} also {wide}".encode())
    assert [x[0] for x in found] == ["gpl-3.0"] * 3 and all(x[1] >= 0.8 for x in found)
    assert all(x[3] <= y[2] for x, y in zip(found, found[1:]))
    assert scan(f"licensed {between(30)} under the {between(30)} license".encode()) == []
