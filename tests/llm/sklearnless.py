"""Plain measures of predictions."""


def precision_recall(pairs):
    """(precision, recall) of ``(predicted, true)`` pairs of 0 and 1."""
    hit = sum(1 for p, y in pairs if p == 1 and y == 1)
    return hit / max(1, sum(p for p, _ in pairs)), hit / max(1, sum(y for _, y in pairs))
