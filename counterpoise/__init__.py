"""counterpoise: pseudo-instances, rebalancing and evaluation for unbalanced labelled text.

Everything is a DataFrame transformation.  Typical use::

    from counterpoise.sources.lines import read_corpus
    from counterpoise.operators.generate import Gen, Lexicons, generate
    from counterpoise.plans.specs import Spec
    from counterpoise.plans.training_sets import build_training_set
    from counterpoise.plans.suites import run_suite
"""

__version__ = "0.1.0"
