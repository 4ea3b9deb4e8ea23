"""Fixed values shared by the operators."""

# Frequent function words by language, lower case. Fixed values.
STOP_WORDS = {
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sch schon sein sich sie sind so über um und uns von vor war was wenn werden wie wir wird zu zum zur",
    "en": "a about after all also an and are as at be been but by can could did do for from had has have he her his how i if in is it its more no not of on one only or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you",
    "es": "al ante como con cuando de del desde donde el ella en entre era es esta está este fue ha hay la las le lo los más me mi muy no nos o para pero por porque que qué se ser si sin sobre son su sus también te tiene un una y ya yo",
    "fr": "au aussi aux avec bien car ce ces cette comme dans de des deux du elle en est et être été eu fait il ils je la le les leur lui mais même ne nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur ta te tout très tu un une vous y à",
}
