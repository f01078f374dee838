"""Invented text for the tests."""


def prose(rnd, n, letters="abcdefghij", longest=6):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, longest))) for _ in range(n))
