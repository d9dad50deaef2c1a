"""A rational function model as RPC text, the sample scene of the queries and tests."""

# The model of the sample scene.
RPC_TEXT = """\
LINE_OFF: 3000.000000000000
SAMP_OFF: 3000.000000000000
LAT_OFF: 40.889931213143
LONG_OFF: 30.873857556133
HEIGHT_OFF: 1102.492393879686
LINE_SCALE: 2666.666666666667
SAMP_SCALE: 2666.666666666667
LAT_SCALE: 0.314752936468
LONG_SCALE: 0.511874828332
HEIGHT_SCALE: 1691.497747135814
LINE_NUM_COEFF_1: 0.000687431689
LINE_NUM_COEFF_2: -0.424158981671
LINE_NUM_COEFF_3: -1.262653799669
LINE_NUM_COEFF_4: 0.000425328784
LINE_NUM_COEFF_5: -0.023730359987
LINE_NUM_COEFF_6: -0.000776098913
LINE_NUM_COEFF_7: -0.002294292922
LINE_NUM_COEFF_8: -0.007124079627
LINE_NUM_COEFF_9: -0.054751923164
LINE_NUM_COEFF_10: 0.000000972942
LINE_NUM_COEFF_11: -0.000913969147
LINE_NUM_COEFF_12: -0.005535733526
LINE_NUM_COEFF_13: 0.026709156487
LINE_NUM_COEFF_14: 0.000207126073
LINE_NUM_COEFF_15: -0.011289136534
LINE_NUM_COEFF_16: 0.034649102684
LINE_NUM_COEFF_17: 0.000615641767
LINE_NUM_COEFF_18: -0.000387410006
LINE_NUM_COEFF_19: 0.000626621269
LINE_NUM_COEFF_20: -0.000000210263
LINE_DEN_COEFF_1: 1.000000000000
LINE_DEN_COEFF_2: 0.005978427894
LINE_DEN_COEFF_3: 0.044069144732
LINE_DEN_COEFF_4: 0.001831486510
LINE_DEN_COEFF_5: -0.011824538813
LINE_DEN_COEFF_6: 0.000894463656
LINE_DEN_COEFF_7: -0.000505822432
LINE_DEN_COEFF_8: 0.012822473731
LINE_DEN_COEFF_9: -0.027373898494
LINE_DEN_COEFF_10: -0.000487724601
LINE_DEN_COEFF_11: 0.000000848832
LINE_DEN_COEFF_12: -0.000057976457
LINE_DEN_COEFF_13: -0.001057598631
LINE_DEN_COEFF_14: 0.000000191386
LINE_DEN_COEFF_15: -0.000222300667
LINE_DEN_COEFF_16: -0.001004839267
LINE_DEN_COEFF_17: -0.000000149049
LINE_DEN_COEFF_18: 0.000000517068
LINE_DEN_COEFF_19: 0.000000955220
LINE_DEN_COEFF_20: 0.000000000378
SAMP_NUM_COEFF_1: 0.025909851699
SAMP_NUM_COEFF_2: 1.168768013982
SAMP_NUM_COEFF_3: -0.303938836443
SAMP_NUM_COEFF_4: 0.028542210047
SAMP_NUM_COEFF_5: 0.096645702253
SAMP_NUM_COEFF_6: 0.001632249702
SAMP_NUM_COEFF_7: 0.002073804928
SAMP_NUM_COEFF_8: 0.019928959745
SAMP_NUM_COEFF_9: -0.031799269875
SAMP_NUM_COEFF_10: -0.000102326162
SAMP_NUM_COEFF_11: -0.012258987740
SAMP_NUM_COEFF_12: -0.110465231811
SAMP_NUM_COEFF_13: -0.138706118917
SAMP_NUM_COEFF_14: -0.005728372198
SAMP_NUM_COEFF_15: -0.017072320506
SAMP_NUM_COEFF_16: 0.039267603322
SAMP_NUM_COEFF_17: 0.001155490115
SAMP_NUM_COEFF_18: -0.008433109405
SAMP_NUM_COEFF_19: -0.000349944557
SAMP_NUM_COEFF_20: -0.000136405588
SAMP_DEN_COEFF_1: 1.000000000000
SAMP_DEN_COEFF_2: 0.044123038659
SAMP_DEN_COEFF_3: 0.087274753452
SAMP_DEN_COEFF_4: -0.000833805414
SAMP_DEN_COEFF_5: -0.037268445328
SAMP_DEN_COEFF_6: -0.004926732536
SAMP_DEN_COEFF_7: -0.010997995116
SAMP_DEN_COEFF_8: -0.093907662706
SAMP_DEN_COEFF_9: -0.129054912644
SAMP_DEN_COEFF_10: -0.004785064538
SAMP_DEN_COEFF_11: -0.000180704618
SAMP_DEN_COEFF_12: -0.002341054607
SAMP_DEN_COEFF_13: -0.003198023906
SAMP_DEN_COEFF_14: -0.000110533704
SAMP_DEN_COEFF_15: -0.000838649412
SAMP_DEN_COEFF_16: 0.000284903353
SAMP_DEN_COEFF_17: 0.000029641110
SAMP_DEN_COEFF_18: 0.000055590129
SAMP_DEN_COEFF_19: 0.000256581431
SAMP_DEN_COEFF_20: 0.000008789757
"""
