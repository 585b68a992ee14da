"""The own comparison is as strict as one by hashes of written values."""

from scripts.check_oracle import equal, rows_of


def test_sign_of_zero_inside_a_list():
    a, b = rows_of(["x"], [([0.0, 1.0],)]), rows_of(["x"], [([-0.0, 1.0],)])
    assert not equal(a, b) and equal(a, rows_of(["x"], [([0.0, 1.0],)]))


def test_plain_columns_and_order():
    assert equal(rows_of(["b", "a"], [(1, -0.0), (2, 1.0)]), rows_of(["a", "b"], [(1.0, 2), (0.0, 1)]))
    assert not equal(rows_of(["a"], [(1,)]), rows_of(["a"], [(1.0,)]))
    assert equal(rows_of(["a"], [(float("nan"),)]), rows_of(["a"], [(float("nan"),)]))
