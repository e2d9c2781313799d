"""Numbers known for superfolder GFP (a public sequence) under a usual stack of synthesis rules."""

from codonlake import CodingSpace, CodonWeights, DirectRepeats, ForbiddenMotifs, Hairpins, InvertedRepeats, MaxHomopolymer, RestrictionSite, TandemRepeats

SFGFP = (
    "MSKGEELFTGVVPILVELDGDVNGHKFSVRGEGEGDATNGKLTLKFICTTGKLPVPWPTLVTTLTYGVQCFSRYPDHMKR"
    "HDFFKSAMPEGYVQERTISFKDDGTYKTRAEVKFEGDTLVNRIELKGIDFKEDGNILGHKLEYNFNSHNVYITADKQKNG"
    "IKANFKIRHNVEDGSVQLADHYQQNTPIGDGPVLLPDNHYLSTQSVLSKDPNEKRDHMVLLEFVTAAGITHGMDELYK"
)


def test_stack_sampling_and_mutants():
    space = CodingSpace(SFGFP, codon_weights=CodonWeights.ecoli(), seed=8675309)
    every = space.count()
    sites = [RestrictionSite[k] for k in ("BsaI", "BsmBI", "BbsI", "EcoRI", "BamHI", "HindIII")]
    tandems = [TandemRepeats(2, 4), *(TandemRepeats(k, 3) for k in (3, 4, 5, 6))]
    space.add_constraints([ForbiddenMotifs(sites), MaxHomopolymer(6), *tandems, DirectRepeats(18), InvertedRepeats(18), Hairpins(12, 3, 8)])
    assert f"{100 * space.count() / every:.2f}" == "6.91"
    reference = space.sample()
    assert [space.mutants(reference, max_nts=k).count() for k in range(1, 6)] == [458, 104358, 15773006, 1779012929, 159714128610]
    assert space.mutants(reference, free_positions=range(60, 65), max_nts=5).count() == 1494
