"""Operators over DataFrames: master list, hypotheses and ranking, repair, labels, passes, images, results."""
